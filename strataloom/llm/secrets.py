"""Secret scans with corpus-wide ownership, in DataFrame operations only.

Patterns find candidates in whole texts; a match's place comes from the lengths of what lies between the matches. The
secret of each candidate is hashed and counted over distinct owners and repositories: one that many owners or very many
repositories hold is an example that gets copied around, one that few hold looks live. The test tables tell no owner and
no repository; there a document's source is its owner, and its language within the source the repository. Base kinds are always reported; further kinds are
reported where they look live.

Defined results: a null text counts as empty; a null owner or repository counts as one; rows may repeat and are all
reported, their owners count once; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: name, pattern, group of the secret, its least length, a cheap test that each text with a match passes; in the order of ties.
BASE = [
    ("assign", ASSIGN, 2, 8, r"(?i)password|passwd|secret|token|api_?key"),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16, "AKIA"),
    ("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
]
MORE = [
    ("provider", r"(?:gh[pousr]_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{16,}|sk_live_[A-Za-z0-9]{16,})", 0, 20, r"gh[pousr]_|glpat-|xox[abprs]-|sk_live_"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 32, "eyJ"),
    ("login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:([^\s:/@]{6,64})@", 1, 6, "://"),
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}", 0, 40, "PRIVATE KEY-----"),
]
KINDS = BASE + MORE
#: A secret that at least so many owners, or so many of their repositories, hold is an example.
WIDE_OWNERS, WIDE_REPOSITORIES = 5, 12


def _found(text: Column, kind: int) -> Column:
    """Matches of one kind: array of (kind, pos, gap before, length, secret or null if too short)."""
    _, pattern, group, least, test = KINDS[kind]
    regex = F.lit(pattern)
    hits = F.regexp_extract_all(text, regex, F.lit(0))
    gaps = F.split(text, pattern, -1)

    def one(hit: Column, i: Column) -> Column:
        secret = F.regexp_extract(hit, pattern, group) if group else hit
        return F.struct(F.lit(kind).alias("kind"), i.alias("pos"), F.length(F.get(gaps, i)).alias("gap"), F.length(hit).alias("size"), F.when(F.length(secret) >= least, F.sha2(secret, 256)).alias("secret"))

    passes = text.rlike(test) if any(c in test for c in "[(|") else text.contains(test)
    none = F.array().cast("array<struct<kind:int,pos:int,gap:int,size:int,secret:string>>")
    return F.when(passes, F.transform(hits, one)).otherwise(none)


def candidates(docs: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """(row, doc_id, owner, repository, found) of every document, durable and without its text. A repository is one within its owner."""
    text = F.coalesce("text", F.lit(""))
    found = F.flatten(F.array(*[_found(text, k) for k in range(len(KINDS))]))
    return common.durable(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.concat_ws("/", F.coalesce(F.col(owner).cast("string"), F.lit("")), F.coalesce(F.col(repository).cast("string"), F.lit(""))).alias("repository"), found.alias("found")))


def located(held: DataFrame) -> DataFrame:
    """(row, owner, repository, kind, begin, end, secret) of the matches that are long enough; begin and end in code points."""
    each = held.where(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("f")).select("row", "owner", "repository", "f.*")
    order = Window.partitionBy("row", "kind").orderBy("pos")  # one document's matches of a kind
    end = F.sum(F.col("gap") + F.col("size")).over(order)
    return each.withColumn("end", end).withColumn("begin", F.col("end") - F.col("size")).where("secret is not null").select("row", "owner", "repository", "kind", "begin", "end", "secret")


def ownership(spans: DataFrame) -> DataFrame:
    """(secret, n, owners, repositories, live): over distinct pairs, so a third of all rows may be of one owner.

    What few owners hold looks live, unless so many repositories hold it that it can only be an example.
    """
    pairs = spans.groupBy("secret", "owner", "repository").agg(F.count("*").alias("n"))
    counts = pairs.groupBy("secret").agg(F.sum("n").alias("n"), F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"))
    return counts.withColumn("live", (F.col("owners") < WIDE_OWNERS) & (F.col("repositories") < WIDE_REPOSITORIES))


def judged(held: DataFrame) -> DataFrame:
    """located() with what ownership says of each secret, durable. A secret that many rows hold is dealt over several tasks."""
    spans = common.durable(located(held))
    known = common.durable(ownership(spans))
    return common.durable(common.join_each(spans, known.drop("n"), ["secret"], "row", spans.count(), counts=known.select("secret", "n")))


_NAMES = "array(" + ",".join(f"'{k[0]}'" for k in KINDS) + ")"


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat({_NAMES}[x.kind], ':', x.begin, ':', x.end)), ',')")


def report(held: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, digest of base spans, all spans, live and example secrets."""
    base = len(BASE)
    per = judged(held).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("begin", "kind", "end", "live"))).alias("s"))  # one document's spans
    per = per.withColumn("base", F.expr(f"filter(s, x -> x.kind < {base})")).withColumn("all", F.expr(f"filter(s, x -> x.kind < {base} or x.live)"))
    number = lambda k: F.coalesce(F.expr(f"size(filter(base, x -> x.kind = {k}))"), F.lit(0)).cast("bigint")
    out = held.select("row", "doc_id").join(per, "row", "left")
    return out.select(
        "doc_id",
        *[number(k).alias(f"n_{BASE[k][0]}") for k in range(base)],
        F.sha2(F.coalesce(_joined("base"), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_joined("all"), F.lit("")).alias("spans"),
        F.coalesce(F.expr("size(filter(s, x -> x.live))"), F.lit(0)).cast("bigint").alias("n_live"),
        F.coalesce(F.expr("size(filter(s, x -> not x.live))"), F.lit(0)).cast("bigint").alias("n_example"),
    )


def redact(docs: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """docs with every reported span replaced by [secret]; all columns stay, whatever their names. Texts without a candidate are not shuffled.

    Spans follow from a text alone and from who holds its secrets, so they are tied to texts by their digest.
    """
    test = "|".join(f"(?:{k[4]})" for k in KINDS).replace("(?i)", "")
    hit = F.coalesce(F.col("text").rlike(f"(?i){test}"), F.lit(False))
    some = docs.where(hit)
    held = candidates(some.select(F.sha2("text", 256).alias("doc_id"), "text", owner, *[c for c in [repository] if c != owner]), owner, repository)
    spans = judged(held).join(held.select("row", "doc_id"), "row").where(f"kind < {len(BASE)} or live")
    merged = F.expr("""aggregate(s, cast(array() as array<struct<begin:bigint,end:bigint>>), (a, x) ->
        case when size(a) > 0 and x.begin < element_at(a, -1).end
             then concat(slice(a, 1, size(a) - 1), array(named_struct('begin', element_at(a, -1).begin, 'end', greatest(element_at(a, -1).end, x.end))))
             else concat(a, array(named_struct('begin', x.begin, 'end', x.end))) end)""")
    digest, cuts = (common.fresh(c, docs.columns) for c in ("digest", "cuts"))
    per = spans.select("doc_id", "begin", "end").distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("begin").cast("bigint").alias("begin"), F.col("end").cast("bigint").alias("end")))).alias("s")).select(F.col("doc_id").alias(digest), merged.alias(cuts))
    clean = F.expr(f"""concat(
        array_join(transform(sequence(0, size({cuts}) - 1), i -> concat(
            substring(text, cast(if(i = 0, 0L, get({cuts}, i - 1).end) + 1 as int), cast(get({cuts}, i).begin - if(i = 0, 0L, get({cuts}, i - 1).end) as int)), '[secret]')), ''),
        substring(text, cast(element_at({cuts}, -1).end + 1 as int), length(text)))""")
    cut = F.size(cuts) > 0
    put = some.withColumn(digest, F.sha2("text", 256)).join(per, digest, "left").withColumn("text", F.when(cut, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        put = put.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return docs.where(~hit).unionByName(put.select(*common.quoted(docs.columns)))


def op5_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(candidates(common.documents(spark, sf_dir)))
