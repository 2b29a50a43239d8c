"""License scans with DataFrame functions only: MinHash bands over overlapping windows, then exact containment.

Templates are license texts, standard headers and short notices. A text is reported for a license if it contains
`LEAST` or more of a template's distinct shingles of five words.

Retrieval. The shingles of texts and templates are hashed and cut into windows of `WINDOW` shingles that start
every `STEP`. Each window has `BANDS` MinHashes (bands of one row each: the least of its hashes after an exclusive
or with the band's seed); a text and a template that agree in one band of two windows are a candidate. Windows of
a near copy are out of step by a quarter of a window at most. With 3/4 of the shingles kept, the windows then
share 9/16 of their shingles, a Jaccard similarity j of 0.39, and meet in one of b bands with probability
1 - (1 - j)^b = 0.86 for b = 4. A template of `LONG` shingles has four windows apart (and three between them), of
which all must miss: it is retrieved with probability 0.9996 or more. Windows cannot carry shorter templates: of m
shingles, floor(m / 4) + 1 are exact keys, one of which every text has that contains 3/4 of them. Bands and keys
are joined tables, so no set of templates is too large.

Verification counts the shingles themselves, as text, for candidates alone.

Defined cases: null and empty texts give no row; words are runs of anything but ASCII white space, ASCII
letters lower-cased, signs at either end of a word dropped; a template with fewer words than a shingle is
one shingle of all its words; templates without words are ignored; repeated template rows count once;
of several templates of a license the one held most counts; repeated document rows each give their rows.
Licenses that share most of their words (GPL headers of two versions, BSD with two and three clauses) each
give a row; a five-word notice with another word is often another license's, so it is no near copy.
"""

from __future__ import annotations

from collections.abc import Sequence
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmatch.llm.common import stored

SHINGLE = 5
LEAST = 0.75
WINDOW, STEP, BANDS = 32, 16, 4
#: Templates of so many shingles or more are found by windows, shorter ones by exact keys.
LONG = 128
#: A table that is known to have no more bytes than this is sent to every task; beyond that Spark chooses the join.
BROADCAST_BYTES = 4 << 20
#: One seed a band, spread over the highest bits, so that each band prefers other hashes.
SEEDS = tuple((k << 62 | 0x5851F42D4C957F2D * (k + 1) % (1 << 62)) - (1 << 64 if k >= BANDS // 2 else 0) for k in range(BANDS))

# The notices that the licenses themselves tell authors to use.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
)
# Other usual wordings; texts and headers are in the folder license_texts, named <license_id>.<kind>.txt.
WORDINGS = (
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("Apache-2.0", "Licensed under the Apache 2.0 License."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "Distributed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Released under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "the GNU General Public License, version 2."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Licensed under the ISC License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Distributed under the MIT License."),
    ("MIT", "Available under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
)


def notice_templates(spark: SparkSession, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    return spark.createDataFrame(list(notices), "license_id string, text string")


def template_rows() -> list[tuple[str, str]]:
    """The texts and headers of the folder license_texts, the notices and their other wordings."""
    files = sorted((f for f in resources.files("postmatch.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    texts = [(f.name.rsplit(".", 2)[0], f.read_text(encoding="utf-8")) for f in files]
    return [*texts, *NOTICES, *WORDINGS]


def license_templates(spark: SparkSession) -> DataFrame:
    return notice_templates(spark, template_rows())


def words_of(text: Column) -> Column:
    plain = F.lower(F.regexp_replace(text, r"[\x09-\x0D\x20]+", " "))
    bare = F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), r"(?<=\x20)[\p{P}\p{S}]+|[\p{P}\p{S}]+(?=\x20)", "")
    return F.filter(F.split(bare, " +"), lambda w: w != "")


def _shingles(words: Column, n: int = SHINGLE) -> Column:
    """The n-word shingles in text order; the whole sequence where it is shorter."""
    size = F.size(words)
    many = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(size >= n, many).when(size > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def _with_hashes(rows: DataFrame, n: int = SHINGLE) -> DataFrame:
    """Adds _g, the hashes of the shingles of the words _w in text order, each from the hashes of its words."""
    size = F.size("_w")
    many = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(n)]))
    shingles = F.when(size >= n, many).when(size > 0, F.array(F.xxhash64("_h"))).otherwise(F.array().cast("array<bigint>"))
    # The condition always holds. It depends on the row's place, so that Spark does not move filters on the hashes
    # below them, where the words' hashes would be taken again for every shingle.
    fixed = F.when(F.monotonically_increasing_id() >= 0, shingles)
    return rows.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).withColumn("_g", fixed).drop("_h")


def _minhash(window: Column, seed: int) -> Column:
    return F.array_min(F.transform(window, lambda x: x.bitwiseXOR(F.lit(seed))))


def _bands(hashes: Column) -> Column:
    """The bands of every window as numbers; seeds differ in their highest bits, so bands do. The last window may be shorter."""
    windows = F.greatest(F.lit(1), F.ceil((F.size(hashes) - WINDOW) / STEP).cast("int") + 1)
    cut = F.transform(F.sequence(F.lit(0), windows - 1), lambda j: F.slice(hashes, j * STEP + 1, F.lit(WINDOW)))
    return F.flatten(F.transform(cut, lambda w: F.array(*[_minhash(w, seed) for seed in SEEDS])))


def candidates(texts: DataFrame, wanted: DataFrame, ids: Sequence[str], broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(ids, _template) that agree in a band of two windows, or in a key of a short template. Both sides have _w and _g."""
    distinct = F.array_distinct("_g")
    some = F.slice(F.array_sort(distinct), F.lit(1), F.floor(F.size(distinct) / 4).cast("int") + 1)
    entries = F.when(F.size(distinct) >= LONG, _bands(F.col("_g"))).otherwise(some)
    index = stored(wanted.select("_template", F.explode(entries).alias("value")).distinct())
    if index.count() * 96 <= broadcast_bytes:
        index = F.broadcast(index)
    # Windows for the bands, single hashes for the keys of short templates.
    asked = texts.filter(F.size("_w") > 0).select(*ids, F.explode(F.concat(_bands(F.col("_g")), F.col("_g"))).alias("value"))
    return asked.join(index, "value").select(*ids, "_template").distinct()


def scan(documents: DataFrame, templates: DataFrame, least: float = LEAST, key: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, license_id, containment, first_word): licenses with a template of which a text holds `least` or more.

    `first_word` is where the first shingle shared with that template begins. `least` is 3/4 or more, or short
    templates would need more keys.
    """
    whole = templates.select("license_id", words_of(F.col("text").cast("string")).alias("_w")).filter(F.size("_w") > 0).distinct()
    wanted = _with_hashes(stored(whole.select("license_id", F.sha2(F.array_join("_w", " "), 256).alias("_template"), "_w")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = documents.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_t"), text.alias("_text"))
    # Evaluated once per text: the row number keeps Spark from moving the words into every use of them.
    texts = _with_hashes(keyed.select("_key", "_t", words_of(F.col("_text")).alias("_w"), F.monotonically_increasing_id().alias("_row")))
    found = stored(candidates(texts, wanted, ["_key", "_t"], broadcast_bytes))

    # Candidates alone are read again and counted exactly.
    near = found.groupBy("_key", "_t").agg(F.collect_set("_template").alias("_templates"))
    size = found.agg(F.sum(F.octet_length("_template") + 32).alias("n")).first()["n"] or 0
    near = F.broadcast(near) if size <= broadcast_bytes else near
    same = keyed["_key"].eqNullSafe(near["_key"]) & (keyed["_t"] == near["_t"])
    again = keyed.join(near, same).select(keyed["_key"], "_templates", words_of(F.col("_text")).alias("_w"), F.monotonically_increasing_id().alias("_row"))
    held = again.select("_key", "_row", "_templates", F.posexplode(_shingles(F.col("_w"))).alias("_p", "_shingle"))
    index = wanted.select("license_id", "_template", F.array_distinct(_shingles(F.col("_w"))).alias("_s"))
    index = stored(index.select("license_id", "_template", F.size("_s").alias("_n"), F.explode("_s").alias("_shingle")))
    hit = held.join(index, "_shingle").filter(F.array_contains("_templates", F.col("_template")))
    counted = hit.groupBy("_key", "_row", "license_id", "_template", "_n").agg(F.count_distinct("_shingle").alias("_held"), F.min("_p").alias("first_word"))
    share = counted.select("_key", "_row", "license_id", (F.col("_held") / F.col("_n")).alias("containment"), "first_word").filter(F.col("containment") >= least)
    best = F.max(F.struct("containment", (-F.col("first_word")).alias("back"))).alias("_best")
    return share.groupBy("_key", "_row", "license_id").agg(best).select(
        F.col("_key").alias(key), "license_id", F.col("_best.containment").alias("containment"), (-F.col("_best.back")).alias("first_word")
    )
