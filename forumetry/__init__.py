"""Discourse analytics on Spark: snapshots of posts, reply trees and re-shares, turned into tables, labels, metrics and reports."""
