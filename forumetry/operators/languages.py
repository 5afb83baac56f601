"""Languages of texts, told by profiles of character n-grams that are learnt from text.

A profile has, for the n-grams that are frequent in any language, the logarithm of their share in each. Words are counted before n-grams are made
of them, so learning shuffles vocabularies, not texts. A text is scored by exploding its n-grams against the broadcast profile, whose size is
bounded by MOST n-grams a language; sums are made before anything is shuffled, so one row a text is. Scripts and words that one language alone
has (stance.language) decide where no profile does.

Weights are whole thousandths, so sums are exact and a text's language doesn't depend on the order of its rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forumetry.functions.text import or_empty
from forumetry.operators.stance import language
from forumetry.operators.store import checkpointed

#: Letters of an n-gram; n-grams of a language that are kept; what an unseen one counts; weights are multiples of 1 / SCALE.
GRAM, MOST, UNSEEN, SCALE = 3, 1_000, 0.5, 1_000
#: The share of a text's n-grams that a profile must know to decide.
LEAST_KNOWN = 0.5

#: Ordinary prose to learn from where no labelled text is given.
SEEDS = {
    "en": "The people of this town have always known that the river would come back in spring. When the water rises they carry what they own to "
    "the upper floors and wait there with their neighbours until it is over. Nobody thinks of leaving, because there is nothing that could be "
    "better than the light in the evening, and which of them would want to live without it? They say they will be here for as long as the houses stand.",
    "fr": "Les gens de cette ville ont toujours su que la rivière reviendrait au printemps. Quand les eaux montent, ils portent leurs affaires dans "
    "les étages et attendent avec leurs voisins que tout soit passé. Personne ne pense à partir, parce que rien ne pourrait être plus beau que la "
    "lumière du soir, et qui voudrait vivre sans elle ? Ils disent qu'ils seront là aussi longtemps que les maisons tiendront debout, où que l'on aille.",
    "de": "Die Menschen in dieser Stadt haben immer gewusst, dass der Fluss im Frühling zurückkommen würde. Wenn das Wasser steigt, tragen sie ihre "
    "Sachen in die oberen Stockwerke und warten dort mit den Nachbarn, bis es vorüber ist. Niemand denkt daran, wegzugehen, weil nichts schöner sein "
    "könnte als das Licht am Abend, und wer möchte schon ohne es leben? Sie sagen, dass sie hier sein werden, solange die Häuser noch stehen.",
    "es": "La gente de esta ciudad siempre ha sabido que el río volvería en primavera. Cuando las aguas suben, llevan sus cosas a los pisos de arriba "
    "y esperan allí con los vecinos hasta que todo haya pasado. Nadie piensa en marcharse, porque no hay nada que pueda ser más hermoso que la luz de "
    "la tarde, y ¿quién querría vivir sin ella? Dicen que estarán aquí mientras las casas sigan en pie, y que los niños también se quedarán mañana.",
    "it": "La gente di questa città ha sempre saputo che il fiume sarebbe tornato in primavera. Quando le acque salgono, portano le loro cose ai piani "
    "alti e aspettano lì con i vicini finché tutto è passato. Nessuno pensa di andarsene, perché non c'è niente che possa essere più bello della luce "
    "della sera, e chi vorrebbe vivere senza? Dicono che resteranno qui finché le case staranno in piedi, e anche i loro figli con gli amici degli altri.",
    "pt": "As pessoas desta cidade sempre souberam que o rio voltaria na primavera. Quando as águas sobem, levam as suas coisas para os andares de "
    "cima e esperam lá com os vizinhos até que tudo tenha passado. Ninguém pensa em ir embora, porque não há nada que possa ser mais bonito do que a "
    "luz da tarde, e quem quereria viver sem ela? Dizem que estarão aqui enquanto as casas ficarem de pé, e que os filhos também não vão deixar a terra.",
    "nl": "De mensen van deze stad hebben altijd geweten dat de rivier in het voorjaar terug zou komen. Als het water stijgt, dragen zij hun spullen "
    "naar de bovenste verdiepingen en wachten daar met hun buren tot het voorbij is. Niemand denkt eraan om weg te gaan, want er is niets dat mooier "
    "kan zijn dan het licht van de avond, en wie zou er zonder willen leven? Zij zeggen dat zij hier zullen zijn zolang de huizen nog blijven staan.",
    "pl": "Ludzie z tego miasta zawsze wiedzieli, że rzeka powróci na wiosnę. Kiedy woda się podnosi, wnoszą swoje rzeczy na wyższe piętra i czekają "
    "tam z sąsiadami, aż wszystko minie. Nikt nie myśli o tym, żeby odejść, bo nie ma nic, co mogłoby być piękniejsze niż światło wieczoru, a kto "
    "chciałby bez niego żyć? Mówią, że będą tutaj tak długo, jak domy będą stały, i że ich dzieci także zostaną z przyjaciółmi, którzy tu są.",
    "uk": "Люди цього міста завжди знали, що річка повернеться навесні. Коли вода піднімається, вони несуть свої речі на верхні поверхи й чекають там "
    "разом із сусідами, доки все мине. Ніхто не думає про те, щоб піти, бо немає нічого, що могло б бути кращим за вечірнє світло, і хто хотів би "
    "жити без нього? Кажуть, що вони будуть тут так довго, як стоятимуть будинки, і що їхні діти теж залишаться, якщо все це ще має сенс для них.",
    "ru": "Люди этого города всегда знали, что река вернётся весной. Когда вода поднимается, они несут свои вещи на верхние этажи и ждут там вместе с "
    "соседями, пока всё пройдёт. Никто не думает о том, чтобы уйти, потому что нет ничего, что могло бы быть лучше вечернего света, и кто захотел бы "
    "жить без него? Говорят, что они будут здесь так долго, как стоят дома, и что их дети тоже останутся, если это ещё имеет смысл для них самих.",
}


@dataclass(frozen=True)
class Profiles:
    """Weights of n-grams: table (gram, weights array<bigint>), one weight for each of `languages`, which are sorted."""

    languages: tuple[str, ...]
    table: DataFrame


def words(text: Column) -> Column:
    """Lower-case runs of letters, their marks and apostrophes; longer ones than 32 in pieces, since an n-gram is found by counting letters."""
    return F.regexp_extract_all(F.lower(or_empty(text)), F.lit(r"[\p{L}\p{M}']{1,32}"), F.lit(0))


def grams(word: Column) -> Column:
    """The n-grams of a word with a blank before and behind it."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.char_length(word) + 3 - GRAM), lambda i: F.substr(padded, i, F.lit(GRAM)))


def learn(labelled: DataFrame, most: int = MOST) -> Profiles:
    """Profiles of labelled (text, language); rows without a language or without words are left out. At most `most` n-grams a language."""
    counted = labelled.where("language IS NOT NULL").select("language", F.explode(words(F.col("text"))).alias("word")).groupBy("language", "word").count()
    made = counted.select("language", "count", F.explode(grams(F.col("word"))).alias("gram")).groupBy("language", "gram").agg(F.sum("count").alias("n"))
    made = checkpointed(made)
    totals = {r.language: r.n for r in made.groupBy("language").agg(F.sum("n").alias("n")).collect()}  # one row a language
    known = tuple(sorted(totals))
    if not known:
        return Profiles((), made.select("gram", F.array().cast("array<bigint>").alias("weights")))
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram"))
    # limits up to spark.sql.optimizer.windowGroupLimitThreshold are applied before the shuffle too
    chosen = checkpointed(made.withColumn("place", place).where(F.col("place") <= most).select("gram").distinct())
    width = chosen.count()
    counts = made.join(F.broadcast(chosen), "gram").groupBy("gram").agg(*(F.coalesce(F.sum(F.when(F.col("language") == x, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, x in enumerate(known)))
    weight = lambda k, x: F.round(SCALE * F.ln((F.col(f"n{k}") + UNSEEN) / (totals[x] + UNSEEN * width))).cast("long")
    return Profiles(known, checkpointed(counts.select("gram", F.array(*(weight(k, x) for k, x in enumerate(known))).alias("weights"))))


def seeded(spark: SparkSession, languages: Iterable[str] | None = None) -> Profiles:
    """Profiles of the prose in SEEDS, of all its languages or of those named."""
    texts = [(text, x) for x, text in SEEDS.items() if languages is None or x in languages]
    return learn(spark.createDataFrame(texts, "text string, language string"))


def scores(items: DataFrame, profiles: Profiles, keys: list[str], keep: list[str]) -> DataFrame:
    """(keys, keep, n_grams, known, score0, ...): the n-grams of each row's text, those that the profiles know, and the sum of their weights in each
    language. Columns in `keep` must be the same for rows with equal keys."""
    tokens = items.select(*keys, *keep, F.explode_outer(words(F.col("text"))).alias("_word"))
    made = tokens.select(*keys, *keep, F.explode_outer(grams(F.col("_word"))).alias("gram"))
    met = made.join(F.broadcast(profiles.table), "gram", "left")
    sums = [F.coalesce(F.sum(F.get("weights", F.lit(k))), F.lit(0)).alias(f"score{k}") for k in range(len(profiles.languages))]
    return met.groupBy(*keys).agg(*(F.first(c).alias(c) for c in keep), F.count("gram").alias("n_grams"), F.count("weights").alias("known"), *sums)


def detect(items: DataFrame, profiles: Profiles, allowed: Iterable[str] | None = None) -> DataFrame:
    """(item_type, item_id, language, confidence, method) of items (item_type, item_id, text).

    The likeliest language of the profiles holds if it is an allowed one (any, if none are named) and the profiles know at least LEAST_KNOWN of
    the text's n-grams; its confidence is its share of the likelihood. Otherwise scripts and words decide, as for null and empty texts. Items
    with equal ids are one.
    """
    keys = ["item_type", "item_id"]
    scored = scores(items.withColumn("_rule", language(F.col("text"))), profiles, keys, ["_rule"])
    names = profiles.languages
    if not names:
        return scored.select(*keys, "_rule.*")
    # of equal scores the first language
    best = F.array_max(F.array(*(F.struct(F.col(f"score{k}").alias("score"), F.lit(-k).alias("place")) for k in range(len(names)))))
    scored = scored.withColumn("_best", best)
    name = F.element_at(F.array(*map(F.lit, names)), 1 - F.col("_best.place"))
    share = 1 / sum((F.exp((F.col(f"score{k}") - F.col("_best.score")) / SCALE) for k in range(len(names))), F.lit(0.0))
    decided = (F.col("known") > 0) & (F.col("known") >= LEAST_KNOWN * F.col("n_grams"))
    if allowed is not None:
        decided &= name.isin(list(allowed))
    found = F.struct(name.alias("language"), F.round(share, 4).alias("confidence"), F.lit("profile").alias("method"))
    return scored.select(*keys, F.when(decided, found).otherwise(F.col("_rule")).alias("l")).select(*keys, "l.*")
