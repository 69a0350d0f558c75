"""Secret scans with corpus-wide ownership of candidates, in DataFrame operations only.

Every text is scanned for the base kinds (assigned passwords and tokens, access keys, long hex strings)
and for further candidates: long strings of a key alphabet with letters and a digit, or letters of both cases.
Each candidate's hash is counted over the whole corpus: in how many documents it occurs and how many owners
(sources) have it. A string that several owners share is a published example or a default; one that a single
owner uses looks like a live credential, in however many documents and copies. Further candidates become spans
only in the latter case; base spans always stay, and the report says how many of them look live.

Positions come from the pieces between matches, so they count code points and texts are never cut. A text may
be very long and hold any number of matches: running sums and overlaps are worked out in blocks. The hash
counts are combined before their shuffle; a candidate in a third of all documents is one row for each task.
The join back is by hash with both sides shuffled, which Spark splits where it is skewed.

Null texts count as empty. Null is an owner like others. Repeated rows are scanned one by one and count once
for each. An empty table gives an empty table; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumewatch.llm.frames import documents, name, store

#: Owners from which on a candidate counts as widely copied.
SHARED_OWNERS = 2

ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
#: A shorter run is dropped whole, and no other match can begin inside it, so the bound may stand here.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Further candidates: maximal runs of a key alphabet; `_mixed` tells keys from words.
LONG = "[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "long")

SPAN = "array<struct<start:int,stop:int,rank:int,kind:string,secret:string>>"


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body (or a lambda in it) names it."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, combine) -> Column:
    """Running sums (or maxima, by `combine`) of an array of ints that are at least 0.

    An array that grows by one element is copied each time, so n values are taken in about sqrt(n) blocks of
    as many, and the blocks' results are carried over: n * sqrt(n) short copies instead of n * n.
    """
    def grown(items, last):
        return F.aggregate(
            items, F.struct(F.array().cast("array<int>").alias("all"), F.lit(0).alias("at")),
            lambda done, x: _let(combine(done["at"], last(x)), lambda now: F.struct(
                F.concat(done["all"], F.array(now)).alias("all"), now.alias("at"))))

    def blocks(v):
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        return _let(size, lambda b: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / b).cast("int")), lambda i: grown(
                F.slice(v, i * b + 1, b), lambda x: x)))

    def carried(done):
        before = F.concat(F.array(F.lit(0)), grown(done, lambda x: x["at"])["all"])
        return F.flatten(F.zip_with(done, F.slice(before, 1, F.size(done)), lambda block, carry: F.transform(
            block["all"], lambda x: combine(carry, x))))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(blocks(v), carried)).otherwise(
        F.array().cast("array<int>")))


def _matches(text: Column, pattern: str, rank: int, secret) -> Column:
    """Spans of all matches. `split` gives the texts between them, which add up to the positions."""
    def spans(hits):
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        ends = _running(F.zip_with(gaps, hits, lambda gap, hit: F.length(gap) + F.length(hit)), lambda a, b: a + b)
        return F.zip_with(hits, ends, lambda hit, end: F.struct(
            (end - F.length(hit)).alias("start"), end.alias("stop"), F.lit(rank).alias("rank"),
            F.lit(KINDS[rank]).alias("kind"), secret(hit).alias("secret")))

    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans).cast(
        SPAN)).otherwise(F.array().cast(SPAN))


def _mixed(text: Column) -> Column:
    """May be a key: letters with a digit or of both cases, and fewer separators than paths and word lists have."""
    breaks = F.regexp_count(text, F.lit("[/_-]"))
    return (text.rlike("[A-Za-z]") & (text.rlike("[0-9]") | (text.rlike("[A-Z]") & text.rlike("[a-z]")))
            & (breaks <= F.greatest(F.lit(3), F.length(text) / 8)))


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others; those of a list do not overlap each other.

    In one order by the spans' ends and the others' starts, a span overlaps if the furthest end of the others
    before it lies behind its start.
    """
    events = F.array_sort(F.concat(
        F.transform(spans, lambda s: F.struct(s["stop"].alias("at"), F.lit(0).alias("stop"), s.alias("span"))),
        F.transform(others, lambda s: F.struct(s["start"].alias("at"), s["stop"].alias("stop"), s.alias("span")))))
    apart = _let(events, lambda e: F.zip_with(
        e, _running(F.transform(e, lambda x: x["stop"]), F.greatest), lambda x, far: F.when(
            (x["stop"] == 0) & (far <= x["span"]["start"]), x["span"])))
    return F.when(F.size(spans) > 0, F.filter(apart, lambda x: x.isNotNull())).otherwise(spans)


def scan(df: DataFrame, text: str = "text", row_id: str = "doc_id", owner: str = "source") -> DataFrame:
    """doc_id, owner, base spans and further candidates of every row, and a row number `rid`.

    The result is a stored table without the texts.
    """
    content = F.coalesce(F.col(name(text)), F.lit(""))
    value = lambda hit: F.regexp_extract(hit, f"^{ASSIGN}$", 2)
    rows = df.select(
        F.col(name(row_id)).alias("doc_id"), F.col(name(owner)).alias("owner"),
        F.filter(_matches(content, ASSIGN, 0, value), lambda s: F.length(s["secret"]) >= 6).alias("assign"),
        _matches(content, ACCESS, 1, lambda hit: hit).alias("access"),
        _matches(content, HEX, 2, lambda hit: hit).alias("hex"),
        F.filter(_matches(content, LONG, 3, lambda hit: hit), lambda s: _mixed(s["secret"])).alias("long"))
    # access keys and hex strings lie inside the runs that they overlap
    more = _apart(F.filter("long", lambda x: ~x["secret"].rlike(ACCESS) & ~x["secret"].rlike(HEX)), F.col("assign"))
    return store(rows.select(
        "doc_id", "owner", F.array_sort(F.concat("assign", "access", "hex")).alias("base"),
        more.alias("more"), F.monotonically_increasing_id().alias("rid")), "secret-scan")[0]


def _hash(secret: Column) -> Column:
    """Of all 256 bits: two keys that met in fewer would look like one that several owners have."""
    return F.unhex(F.sha2(secret.cast("binary"), 256))


def ownership(rows: DataFrame) -> DataFrame:
    """For each candidate hash the number of documents and of owners that have it."""
    # distinct strings, not their hashes: of binary values each would be compared with all others
    held = rows.select("owner", F.explode(F.array_distinct(F.transform(
        F.concat("base", "more"), lambda s: s["secret"]))).alias("secret"))
    return held.withColumn("hash", _hash(F.col("secret"))).groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("documents")).groupBy("hash").agg(
        F.sum("documents").alias("documents"), F.count(F.lit(1)).alias("owners"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secrets(df: DataFrame, text: str = "text", row_id: str = "doc_id", owner: str = "source",
            shared_owners: int = SHARED_OWNERS) -> DataFrame:
    """doc_id, `base` and `spans`: sorted arrays of spans with the secret, the numbers of documents and owners
    that have it, and whether it looks live."""
    rows = scan(df, text, row_id, owner)
    stats = ownership(rows).select(F.col("hash").alias("s_hash"), "documents", "owners",
                                   (F.col("owners") < shared_owners).alias("live"))
    each = rows.select("rid", F.explode(F.concat("base", "more")).alias("span")).withColumn(
        "hash", _hash(F.col("span.secret")))
    # spans of one row come together again; a row never has more than its own text gave
    judged = each.join(stats, F.col("hash") == F.col("s_hash")).where(
        F.col("live") | (F.col("span.rank") < 3)).groupBy("rid").agg(F.array_sort(F.collect_list(
            F.struct("span.start", "span.rank", "span.stop", "span.kind", "span.secret", "live",
                     "documents", "owners")))
            .alias("spans")).withColumnRenamed("rid", "j_rid")
    none = F.array().cast(
        "array<struct<start:int,rank:int,stop:int,kind:string,secret:string,live:boolean,documents:bigint,owners:bigint>>")
    spans = F.coalesce("spans", none)
    return rows.join(judged, F.col("rid") == F.col("j_rid"), "left").select(
        "doc_id", F.filter(spans, lambda s: s["rank"] < 3).alias("base"), spans.alias("spans"))


def op10_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(documents(spark, sf_dir).select("doc_id", "text", "source"))

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    def joined(field: str) -> Column:
        return F.array_join(F.transform("spans", lambda s: s[field].cast("string")), ",")

    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"), live.alias("n_live"),
        joined("documents").alias("span_documents"), joined("owners").alias("span_owners"))
