import copy
import json

from forumetry.operators import merge, store
from forumetry.schemas import MANIFEST
from forumetry.sources import manifests
from forumetry.streaming import merging

from .test_snapshots import snapshot


def passes():
    one, two, three = snapshot("r1", warnings=["old"]), snapshot("r2", extra=True, message="First, longer", warnings=["old", "new"]), snapshot("r3")
    two["posts"][0]["comments"][0] |= {"author": {"author_id": "u2", "name": "Second", "profile_url": None}, "reactions": 7}
    two["posts"][1] |= {"author": {"author_id": "u1", "name": "Renamed", "profile_url": "u"}, "created_at": "2026-04-09T00:00:00+00:00", "views": 5}
    three["posts"][0] |= {"message": "Other, longer", "permalink": "late", "reactions": 3, "source_collector": "last", "media_refs": [{"media_id": "m1", "media_type": "video"}, {"media_id": "m2"}]}
    three["posts"].append(copy.deepcopy(three["posts"][1]) | {"post_id": "post_3", "message": None})
    three["posts"].append(copy.deepcopy(three["posts"][0]) | {"has_media": True, "comments_count": 9})
    three["source"] |= {"fan_count": 12, "about": "More"}
    return one, two, three


def land(folder, *snapshots):
    for s in snapshots:
        (folder / s["run_id"]).mkdir(parents=True, exist_ok=True)
        (folder / s["run_id"] / "manifest.json").write_text(json.dumps(s))


def rows(tables):
    return {name: sorted(map(str, df.collect())) for name, df in tables.items()}


def test_three_passes_by_stream_equal_all_at_once(spark, tmp_path):
    raw, root, at = tmp_path / "raw", str(tmp_path / "state"), str(tmp_path / "checkpoint")
    other = snapshot("r9", source="page_2")
    for some in (passes()[:1], (*passes()[1:2], other), passes()[2:]):
        land(raw, *some)
        assert merging.ingest_merged(spark, str(raw), root, at).awaitTermination(300)
    read = manifests.read_manifests(spark, f"{raw}/*/manifest.json")
    want = rows(merge.merged_tables(read, ["r1", "r2", "r3"], "r3", MANIFEST))
    assert rows(merging.merged_so_far(spark, root, "r3")) == want
    assert rows(merging.merged_so_far(spark, root, "r9"))["posts"] == rows(merge.merged_tables(read, ["r9"], "r9", MANIFEST))["posts"]
    # a batch that is run again changes nothing, nor do passes that come in another order
    merging.fold(read.where("run_id = 'r2'"), root)
    assert rows(merging.merged_so_far(spark, root, "r3")) == want
    again = str(tmp_path / "again")
    for run in ("r3", "r1", "r2"):
        merging.fold(read.where(f"run_id = '{run}'"), again)
    assert rows(merging.merged_so_far(spark, again, "r3")) == want


def test_a_batch_touches_the_buckets_of_its_posts(spark, tmp_path):
    root, raw = str(tmp_path / "state"), tmp_path / "raw"
    first = snapshot("r1")
    first["posts"] = [dict(copy.deepcopy(first["posts"][1]), post_id=f"p{k}") for k in range(400)]
    second = snapshot("r2")
    second["posts"] = first["posts"][:3]
    land(raw, first, second)
    read = manifests.read_manifests(spark, f"{raw}/*/manifest.json")
    merging.fold(read.where("run_id = 'r1'"), root)
    before = store.current(spark, root, "merged_posts").folders
    merging.fold(read.where("run_id = 'r2'"), root)
    after = store.current(spark, root, "merged_posts").folders
    assert len(before) > 40 and 1 <= sum(before[k] != after[k] for k in before) <= 3
