"""Personal data: base patterns, and bootstrapped contextual extraction.

The base finds emails, addresses of the Internet Protocol, payment cards and
telephone numbers by fixed patterns (possessive, so that they are linear and
need no recursion on long runs; a look-behind or the end of the last match
says where a match can begin, which gives the same leftmost matches).

The method adds identifiers that no base pattern describes.  Candidates are
words with a digit, each with its *instance* (the word without punctuation at
its edges) and its lexical *pattern*: its left neighbours with digits folded,
and its own shape.  Seeds are candidates that hold base entities or follow a
credential's name with ``=`` or ``:``.  Pattern and instance scores are then
computed in turns over the graph of their distinct pairs: a pattern's score is
the mean score of its instances, less a term for few of them; an instance's
the best of its patterns.  Patterns that reach ``CONFIDENT`` with ``SUPPORT``
distinct instances give their unseen instances as spans of kind ``id``.  What
is a seed in one context is one in all, and instances of confident patterns are
seeds of a next hop, until a hop finds no further pattern.

Only DataFrame and SQL functions run.  Pairs are pre-aggregated to distinct
ones before any join, and hot patterns and instances are kept to their counts.

Defined results: null text counts as empty; positions are code points, the end
exclusive; every row gives a row; repeated rows are rows of their own; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialise, release

CONFIDENT, SUPPORT, ROUNDS, PRIOR = 0.8, 3, 2, 0.5
#: Elements of a running sum's block.
BLOCK = 256
#: Stands for the characters of a base span; no base pattern holds it.
MARK, WORD_CHAR = "\u0001", r"[^\x20\x09-\x0D]"
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))
#: What a text must hold to have a match at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_NAME = r"(?i)(?:^|[^a-z])(?:token|secret|password|passwd|pwd|api_?key|access_?key|key|ssn|iban|passport|account|license|auth|bearer|credential)[^a-z]*$"


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once."""
    return F.transform(F.array(value), fn)[0]


def _running(steps: Column) -> Column:
    """Running sums of an array of longs, by blocks: appending to one growing array
    would take time with the square of its length."""

    def sums(x: Column, start: Column, inclusive: bool) -> Column:
        return F.aggregate(
            x,
            F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out")),
            lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"] + v if inclusive else acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )

    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / BLOCK).cast("int")), lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK)))
    zero = F.lit(0).cast("long")
    total = lambda x: F.aggregate(x, zero, lambda acc, v: acc + v)
    starts = lambda blocks: sums(F.transform(blocks, total), zero, False)
    return _let(_let(steps, cut), lambda blocks: _let(starts(blocks), lambda at: F.flatten(F.transform(blocks, lambda x, k: sums(x, at[k], True)))))


def _parts(text: Column, pattern: str) -> Column:
    """A text as an array of (p, m): what lies before a match, and the match; the
    last has no match."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))


def _spans(text: Column, pattern: str) -> Column:
    """All matches as an array of (start, end, value), in code points.

    The pieces between matches give the positions: a match begins after all
    pieces up to it and all matches before it.
    """
    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")

    def spans(z: Column) -> Column:
        ends = _running(F.transform(z, lambda x: size(x["p"]) + size(x["m"])))
        one = lambda end, m: F.struct((end - size(m)).alias("s"), end.alias("e"), m.alias("v"))
        return F.filter(_let(ends, lambda at: F.transform(z, lambda x, k: one(at[k], x["m"]))), lambda x: x["v"].isNotNull())

    return _let(_parts(text, pattern), spans)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, k: acc
        + F.when(
            (n - k) % 2 == 1,
            F.when(F.substring(digits, k, F.lit(1)).cast("int") > 4, F.substring(digits, k, F.lit(1)).cast("int") * 2 - 9).otherwise(F.substring(digits, k, F.lit(1)).cast("int") * 2),
        ).otherwise(F.substring(digits, k, F.lit(1)).cast("int")),
    )
    return total % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            F.split(v, r"\."), lambda p: F.coalesce(F.right(F.concat(F.lit("0"), p), F.lit(4)).cast("int"), F.lit(0)) <= 255
        )
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _check(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["v"])


def base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, doc_id, text, email, ip, card, phone)``: spans of every kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    none = F.array().cast("array<struct<s:bigint,e:bigint,v:string>>")
    for kind in KINDS:
        may = F.contains("text", F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        cheap = {"card": r"[0-9](?:[\x20-]?[0-9]){15}", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "phone": r"\+[0-9]", "email": r"@[A-Za-z0-9-]++\."}[kind]
        hit = may & F.col("text").rlike(cheap)
        rows = rows.withColumn(kind, F.when(hit, F.filter(_spans(F.col("text"), PATTERNS[kind]), _check(kind))).otherwise(none))
    return rows


def _masked(kind: str) -> Column:
    """A text whose valid spans of a kind hold a mark for every character but white space."""
    mark = lambda m: F.when(_valid(kind, m), F.regexp_replace(m, WORD_CHAR, MARK)).otherwise(m)
    one = lambda x: F.concat(x["p"], F.coalesce(mark(x["m"]), F.lit("")))
    return F.when(F.size(kind) > 0, F.array_join(F.transform(_parts(F.col("text"), PATTERNS[kind]), one), "")).otherwise(F.col("text"))


def candidates(rows: DataFrame) -> DataFrame:
    """Words with a digit: ``(row, s, e, inst, pat, covered, seed)`` in exploded form.

    The words' arrays stay in their row: what is exploded is one small struct for
    each candidate, so that the work is in proportion to the text.
    """
    space, digit = r"[\x20\x09-\x0D]+", "[0-9]"
    lengths = lambda k: F.transform(k, lambda x: F.length(x).cast("long"))

    def each(x: Column) -> Column:
        w, masked = x["w"], [x[k] for k in KINDS]
        at = F.filter(F.transform(w, lambda v, i: F.when(v.rlike(digit), i)), lambda i: i.isNotNull())

        def one(i: Column) -> Column:
            lo = F.greatest(F.lit(0), i - 2)
            start = F.when(i == 0, F.lit(0).cast("long")).otherwise(x["ends"][i - 1])
            covered = reduce(or_, [F.coalesce(m[i] != w[i], F.lit(False)) for m in masked])
            return F.struct(start.alias("at"), w[i].alias("word"), F.array_join(F.slice(w, lo + 1, i - lo), " ").alias("left"), covered.alias("covered"))

        return F.transform(at, one)

    words = lambda c: F.split(c, space, -1)
    w = words(F.col("text"))
    gaps = lengths(F.regexp_extract_all("text", F.lit(space), F.lit(0)))
    ends = _running(F.zip_with(lengths(w), gaps, lambda a, b: a + F.coalesce(b, F.lit(0).cast("long"))))
    mine = F.struct(w.alias("w"), ends.alias("ends"), *[F.when(F.size(k) > 0, words(_masked(k))).alias(k) for k in KINDS])
    found = rows.where(F.col("text").rlike(digit)).select("row", F.explode(_let(mine, each)).alias("x")).select("row", "x.*")
    bare = F.regexp_replace("word", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    skip = F.length(F.regexp_extract("word", r"^[^\p{L}\p{N}]*", 0))
    found = found.withColumn("inst", bare).withColumn("s", F.col("at") + skip).withColumn("e", F.col("s") + F.length("inst"))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("inst", r"[0-9]+", "9"), r"\p{Lu}+", "A"), r"\p{Ll}+", "a")
    shape = F.when(F.length("inst") >= 20, F.lit("long")).otherwise(shape)
    left = F.regexp_replace(F.lower("left"), "[0-9]", "9")
    named = F.coalesce(F.col("left").rlike(_NAME) & F.col("left").rlike(r"[:=]$"), F.lit(False)) & (F.length("inst") >= 6)
    return found.where("inst rlike '[0-9]'").select("row", "s", "e", "inst", F.concat_ws("|", left, shape).alias("pat"), "covered", (F.col("covered") | named).alias("seed"))


def confident(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Patterns whose score over the pattern-instance graph is high enough.

    A hop is ``rounds`` turns of scores from the known instances.  The instances
    of its confident patterns are known in the next hop; the last hop is the one
    that finds no further pattern.  Scores below ``CONFIDENT`` end with their hop:
    carried on, they would lift every pattern with a few seeds by its own score.
    """
    pairs = materialise(found.groupBy("pat", "inst").agg(F.max(F.col("seed").cast("double")).alias("seed")), "pairs")
    known = materialise(pairs.where("seed > 0").select("inst").distinct(), "known")
    # Patterns below the support can never be confident; what they know of instances is kept above.
    support = pairs.groupBy("pat").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    graph = materialise(pairs.select("pat", "inst").join(support, "pat"), "graph")
    release(pairs)
    good = None
    while True:
        first = graph.join(known.withColumn("score", F.lit(1.0)), "inst", "left").select("pat", "inst", "n", F.coalesce("score", F.lit(0.0)).alias("seed"))
        scores = first.withColumnRenamed("seed", "score")
        for k in range(rounds):
            patterns = scores.groupBy("pat", "n").agg((F.sum("score") / (F.col("n") + PRIOR)).alias("p"))
            if k < rounds - 1:
                high = first.join(patterns.select("pat", "p"), "pat").groupBy("inst").agg(F.greatest(F.max("seed"), F.max("p")).alias("score"))
                scores = graph.join(high, "inst").select("pat", "inst", "n", "score")
        new = patterns.where(F.col("p") >= CONFIDENT).select("pat")
        new = materialise(new if good is None else new.join(good, "pat", "left_anti"), "patterns")
        if new.isEmpty():
            return new if good is None else good
        good = new if good is None else good.unionByName(new)
        more = graph.join(new, "pat", "left_semi").select("inst").distinct().join(known, "inst", "left_anti")
        known = known.unionByName(materialise(more, "known"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and discovered spans of every row: ``(doc_id, email, ip, card,
    phone, id)``, each an array of (s, e, v)."""
    rows = base(docs, id_col, text_col)
    spans = materialise(
        rows.where(F.col("text").rlike("[0-9@]")).withColumn("row", F.struct("doc_id", F.xxhash64("text").alias("t"))).select("row", "text", *KINDS), "spans"
    )
    found = materialise(candidates(spans).distinct(), "candidates")
    good = confident(found)
    new = found.where(~F.col("covered")).join(good, "pat", "left_semi").select("row", F.struct("s", "e", F.col("inst").alias("v")).alias("x")).distinct()
    new = new.groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("id"))
    have = spans.select("row", *KINDS).distinct().join(new, "row", "left")
    have = materialise(have, "found").withColumn("_d", F.col("row.doc_id")).withColumn("_t", F.col("row.t"))
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    out = every.join(have, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")), "left")
    none = F.array().cast("array<struct<s:bigint,e:bigint,v:string>>")
    return out.select("doc_id", *[F.coalesce(k, none).alias(k) for k in (*KINDS, "id")])


def _shown(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string"))


def _listed(kinds: tuple[str, ...]) -> Column:
    parts = [F.transform(k, _shown(k)) for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all ``documents``."""
    f = find(load(spark, sf_dir, "documents"))
    return f.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_listed(KINDS), 256).alias("base_sha256"),
        _listed((*KINDS, "id")).alias("spans"), F.size("id").cast("long").alias("n_id"),
    )


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many base spans of each kind all ``documents`` have."""
    return query(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in KINDS])


PART_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email,
         regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
         list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card,
         list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone
  FROM d
)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email,
  CAST(len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(p AS INT), 256) > 255)) = 0)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(card, lambda x: length(x) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda k:
    CASE WHEN k % 2 = 1 THEN CAST(substr(reverse(x), k, 1) AS INT) ELSE CAST(substr(reverse(x), k, 1) AS INT) * 2 // 10 + CAST(substr(reverse(x), k, 1) AS INT) * 2 % 10 END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(phone, lambda x: length(x) BETWEEN 8 AND 15)) AS BIGINT) AS n_phone
FROM m
"""
