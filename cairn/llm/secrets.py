"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers. Column functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns, in the order in which spans of one start are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run shorter than the least length never matches and never hides a longer match, so the length stands in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "model")
#: What the models judge: runs of the characters of encoded strings.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

#: The models' alphabet: the candidates' characters in order of code points; index 0 stands for the start and any other.
ALPHABET = "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
WIDTH = len(ALPHABET) + 1
BACKOFF = 10.0


#: Elements that one step of a running value goes through.
STRIDE = 256


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, combine, start: int) -> Column:
    """For each element of a long array, combine() of all before it (start for the first). By strides: linear for all practical lengths."""
    def run(items, of):
        state = F.struct(F.lit(start).cast("long").alias("acc"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(items, state, lambda s, x: F.struct(combine(s["acc"], of(x)).alias("acc"), F.concat(s["out"], F.array(s["acc"])).alias("out")))

    strides = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / STRIDE).cast("int")), lambda k: run(F.slice(values, k * STRIDE + 1, STRIDE), lambda x: x))
    return _let(strides, lambda parts: F.flatten(F.zip_with(parts, run(parts, lambda p: p["acc"])["out"], lambda p, before: F.transform(p["out"], lambda x: combine(x, before)))))


def _pairs(text: Column) -> Column:
    """Indices of each character with the one before it: previous * WIDTH + this."""
    at = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return _let(at, lambda a: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(a, 1, F.size(a) - 1)), a, lambda before, this: before * WIDTH + this))


def train(samples: DataFrame) -> list[float]:
    """log2 P(char | previous, random) - log2 P(char | previous, ordinary) for each pair of the alphabet.

    Pairs are smoothed by the label's single characters (BACKOFF of them for each previous one), and these by adding a half.
    samples: text, random (boolean). Null texts or labels are left out; with no samples of a label its model is uniform.
    The counts are at most 2 * WIDTH ** 2 rows, whatever the samples, and only they come to the driver.
    """
    counts = samples.where("text is not null and random is not null and text <> ''").select("random", F.explode(_pairs(F.col("text"))).alias("pair")).groupBy("random", "pair").count()
    table = {k: [0.0] * WIDTH**2 for k in (True, False)}
    for r in counts.collect():
        table[r["random"]][r["pair"]] += r["count"]

    def likelihoods(n: list[float]) -> list[float]:
        single = [sum(n[c::WIDTH]) + 0.5 for c in range(WIDTH)]
        single = [x / sum(single) for x in single]
        row = [sum(n[i * WIDTH : (i + 1) * WIDTH]) + BACKOFF for i in range(WIDTH)]
        return [math.log2((x + BACKOFF * single[i % WIDTH]) / row[i // WIDTH]) for i, x in enumerate(n)]

    return [a - b for a, b in zip(likelihoods(table[True]), likelihoods(table[False]))]


def labelled_samples(spark: SparkSession, docs: DataFrame | None = None, size: int = 4000, text_col: str = "text") -> DataFrame:
    """Labelled strings: random ones are seeded digests in hex, base64 and base36; ordinary ones are identifiers as in code, and words.

    size strings of each label (a documented bound on what the models are fitted on). Ordinary ones are joins of common words
    in snake, camel, kebab, path and constant style with small numbers, and, if docs are given, long words without digits from them, as they are and in capitals.
    """
    words = "get set user name file path index count value data table column row list map key parse read write open close load save config server client request response handler manager factory builder test case main module package version update delete insert select create remove start stop time date size length width height left right first last next previous error message status result default option source target input output buffer cache model train batch node edge graph tree leaf block chunk token vector matrix image frame pixel sensor camera pose depth street north county library museum international development information".split()
    n = F.col("id")

    def word(k: int) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(n, F.lit(k)), F.lit(len(words))) + 1).cast("int"))

    digest = F.concat(F.sha2(n.cast("string"), 256), F.md5(n.cast("string")))
    upper = F.upper(F.concat(*[F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 36) for i in range(4)]))
    random = F.when(n % 3 == 0, F.substring(digest, 1, 40)).when(n % 3 == 1, F.substring(F.base64(F.unhex(digest)), 1, 40)).otherwise(F.substring(upper, 1, 32))
    cap = [F.initcap(word(k)) for k in range(4)]
    ordinary = (F.when(n % 6 == 0, F.concat_ws("_", *map(word, range(4)))).when(n % 6 == 1, F.concat(word(0), *cap[1:])).when(n % 6 == 2, F.concat_ws("/", *map(word, range(4))))
                .when(n % 6 == 3, F.concat_ws("-", word(0), word(1), word(2), (n % 100).cast("string"))).when(n % 6 == 4, F.upper(F.concat_ws("_", *map(word, range(3))))).otherwise(F.concat(*map(word, range(3)))))
    ids = spark.range(size)
    samples = ids.select(random.alias("text"), F.lit(True).alias("random")).unionByName(ids.select(ordinary.alias("text"), F.lit(False).alias("random")))
    if docs is not None:
        long_words = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"\b[A-Za-z]{12,}\b"), F.lit(0))).alias("text")).distinct()
        long_words = long_words.orderBy(F.xxhash64("text"), "text").limit(size // 2)
        samples = samples.unionByName(long_words.select(F.explode(F.array("text", F.upper("text"))).alias("text"), F.lit(False).alias("random")))
    return samples


_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int, keep=None, group: int | None = None) -> Column:
    """Array of (start, kind, end, value) of all leftmost matches: the gaps between them give their places. Code points, end exclusive."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = match if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gap = F.transform(F.split(text, pattern, -1), F.char_length)

    def placed(rows):
        before = _running(F.transform(rows, lambda x: (x["gap"] + x["size"]).cast("long")), lambda a, b: a + b, 0)
        return F.zip_with(rows, before, lambda x, at: F.struct((at + x["gap"]).cast("int").alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["size"]).cast("int").alias("end"), x["inner"].alias("value")))

    rows = _let(match, lambda m: F.zip_with(F.arrays_zip(m.alias("match"), inner.alias("inner")), F.slice(gap, 1, F.greatest(F.size(m), F.lit(0))), lambda x, g: F.struct(g.alias("gap"), F.char_length(x["match"]).alias("size"), x["inner"].alias("inner"))))
    found = _let(rows, placed)
    return (found if keep is None else F.filter(found, keep)).cast(_SPAN)


def _apart(candidates: Column, base: Column) -> Column:
    """Candidates that no base span overlaps: in the order of base starts and candidates' ends, none of the ends before reaches a candidate's start."""
    event = lambda at, is_base, s: F.struct(at.cast("int").alias("at"), F.lit(is_base).alias("base"), s.alias("s"))
    events = F.array_sort(F.concat(F.transform(base, lambda s: event(s["start"], 1, s)), F.transform(candidates, lambda s: event(s["end"], 0, s))))

    def free(every):
        reach = _running(F.transform(every, lambda e: F.when(e["base"] == 1, e["s"]["end"]).otherwise(0).cast("long")), F.greatest, 0)
        marked = F.zip_with(every, reach, lambda e, r: F.struct(((e["base"] == 0) & (r <= e["s"]["start"])).alias("free"), e["s"].alias("s")))
        return F.transform(F.filter(marked, lambda m: m["free"]), lambda m: m["s"])

    return F.when(F.size(candidates) > 0, _let(events, free)).otherwise(candidates)


def _if_any(text: Column, pattern: str, spans: Column) -> Column:
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, model: list[float], threshold: float = 1.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of (start, kind, end, value) for each row of docs.

    base: matches of the fixed patterns, leftmost and non-overlapping for each kind; assignments count if the value has 8
    characters or more. spans adds candidates that no base span touches and whose mean log-likelihood ratio is threshold bits
    a character or more. Null and empty texts have no spans; rows are independent, so repeats and null ids need no care.
    Other columns of docs are not read, whatever their names. The work grows with a text's length, whatever it holds.
    """
    ratios = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")  # folded to one constant
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    base = F.concat(
        _if_any(text, ASSIGN, _spans(text, ASSIGN, 0, lambda s: F.char_length(s["value"]) >= 8, 2)),
        _if_any(text, ACCESS, _spans(text, ACCESS, 1)),
        _if_any(text, HEX, _spans(text, HEX, 2)),
    )
    score = lambda v: F.aggregate(_pairs(v), F.lit(0.0), lambda a, i: a + F.element_at(ratios, (i + 1).cast("int"))) / F.char_length(v)
    likely = _if_any(text, CANDIDATE, _spans(text, CANDIDATE, 3, lambda s: score(s["value"]) >= threshold))
    rows = rows.select("id", base.alias("base"), likely.alias("likely"))
    return rows.select("id", "base", F.concat("base", _apart(F.col("likely"), F.col("base"))).alias("spans"))
