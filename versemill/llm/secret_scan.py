"""Secret scan with corpus-wide ownership frequency.

Patterns give candidates with their places. The hash of every candidate's value is
counted over distinct repositories and owners: a value that many of both hold is a
widely copied example, one that a single owner holds is a live-looking credential of
that owner. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.llm.common import exploded, prefix_sums, stored

# The base patterns. Of an assignment the value is the second group.
KEYWORD = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
LEAD = KEYWORD + r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = LEAD + r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "opaque")
# What the method adds: long tokens without context, if they look random and one owner holds them.
OPAQUE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
# An example is held by at least this many owners and repositories.
COPIED_OWNERS = 3
COPIED_REPOSITORIES = 3
# An added token has at least this many different characters, a digit, and letters of both cases.
VARIETY = 12


def _matches(text: Column, pattern: str, kind: str, lead: str | None = None) -> Column:
    """All leftmost non-overlapping matches: array of (start, rank, kind, end, value), in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    lengths = F.zip_with(found, between, lambda m, b: F.char_length(b) + F.char_length(F.coalesce(m, F.lit(""))))
    before = prefix_sums(F.transform(lengths, lambda n: n.cast("bigint")))

    def span(start: Column, gap_and_match: Column) -> Column:
        match = gap_and_match["m"]
        at = start + F.char_length(gap_and_match["b"])
        value = F.regexp_replace(match, "^" + lead, "") if lead else match
        return F.struct(
            at.cast("bigint").alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            F.lit(kind).alias("kind"),
            (at + F.char_length(match)).cast("bigint").alias("end"),
            value.alias("value"),
        )

    pairs = F.zip_with(between, found, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    return F.filter(F.zip_with(before, pairs, span), lambda x: x["value"].isNotNull())


NONE = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string>>"


def candidates(text: Column) -> dict[str, Column]:
    """Span arrays of each kind. A cheap test that every match implies comes before each pattern."""
    none = F.array().cast(NONE)
    lower = F.lower(text)
    named = lower.contains("passw") | lower.contains("secret") | lower.contains("token") | lower.contains("api")
    assign = F.filter(_matches(text, ASSIGN, "assign", LEAD), lambda x: F.char_length(x["value"]) >= 8)
    access = F.filter(_matches(text, ACCESS, "access"), lambda x: F.char_length(x["value"]) >= 16)
    opaque = F.filter(
        _matches(text, OPAQUE, "opaque"),
        lambda x: (F.size(F.array_distinct(F.split(x["value"], ""))) >= VARIETY)
        & x["value"].rlike("[0-9]")
        & x["value"].rlike("[A-Z]")
        & x["value"].rlike("[a-z]"),
    )
    return {
        "assign": F.when(named, assign).otherwise(none),
        "access": F.when(text.contains("AKIA"), access).otherwise(none),
        "hex": F.when(text.rlike(HEX), _matches(text, HEX, "hex")).otherwise(none),
        "opaque": F.when(text.rlike(OPAQUE), opaque).otherwise(none),
    }


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))),
        ",",
    )


def find(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows, judged): base spans of every row, and the verdict on every distinct row with candidates.

    ``rows``: doc_id, text_key (the text's hash), base (spans by start, then kind) and
    the counts of each kind. ``judged``: doc_id, text_key, and the spans with their
    ``owners``, ``repositories`` and verdict ``copied``, by start, then kind. Null and
    empty texts have no spans; rows equal in id and text share one judgement; a null
    owner or repository counts as none. Added tokens that overlap a base span are that
    span and are not added again.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.xxhash64(text_col).alias("text_key"),
        owner.cast("string").alias("owner"),
        repository.cast("string").alias("repository"),
        *(c.alias(k) for k, c in candidates(text).items()),
    )
    base = F.array_sort(F.concat("assign", "access", "hex"))
    spare = F.filter(
        "opaque",
        lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])),
    )
    each = each.withColumn("base", base).select(
        "doc_id",
        "text_key",
        "owner",
        "repository",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]),
        "base",
        F.concat("base", spare).alias("spans"),
    )
    each = stored(each, "secrets")
    held = exploded(each, "spans", "span", "doc_id", "text_key", "owner", "repository").withColumn(
        "value_key", F.sha2(F.col("span.value"), 256)
    )
    # Repeats of a value in one repository go in the partial aggregation, before any row is sent.
    places = held.select("value_key", "owner", "repository").distinct()
    spread = places.groupBy("value_key").agg(
        F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories")
    )
    copied = (F.col("owners") >= COPIED_OWNERS) & (F.col("repositories") >= COPIED_REPOSITORIES)
    marked = held.select("doc_id", "text_key", "span", "value_key").distinct().join(spread, "value_key")
    marked = marked.withColumn("copied", copied).where((F.col("span.kind") != "opaque") | (F.col("owners") <= 1))
    full = F.struct(
        *(F.col(f"span.{k}").alias(k) for k in ("start", "rank", "kind", "end")), "owners", "repositories", "copied"
    )
    judged = marked.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(full)).alias("judged"))
    return each.select("doc_id", "text_key", "n_assign", "n_access", "n_hex", "base"), judged


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def scan(docs: DataFrame, **columns) -> DataFrame:
    """One row per input row: the base spans, all spans, and how many are live-looking or copied examples."""
    rows, judged = find(docs, **columns)
    all_ = F.coalesce("judged", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,owners:bigint,repositories:bigint,copied:boolean>>"))
    return (
        rows.join(judged, _same(rows, judged), "left")
        .select(rows["doc_id"], "n_assign", "n_access", "n_hex", "base", all_.alias("all"))
        .select(
            "doc_id",
            "n_assign",
            "n_access",
            "n_hex",
            F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
            joined(F.col("all")).alias("spans"),
            F.size(F.filter("all", lambda x: ~x["copied"])).cast("bigint").alias("n_live"),
            F.size(F.filter("all", lambda x: x["copied"])).cast("bigint").alias("n_copied"),
        )
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[REDACTED]", **columns) -> DataFrame:
    """``docs`` with every live-looking span replaced by ``mark``; examples and other columns stay as they are.

    Overlapping spans are replaced once, from the first start to the last end.
    """
    _, judged = find(docs, id_col, text_col, **columns)
    live = judged.select("doc_id", "text_key", F.filter("judged", lambda x: ~x["copied"]).alias("live"))
    live = live.where(F.size("live") > 0)
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.xxhash64(text_col).alias("text_key"),
        F.col(text_col).alias("text"),
    )
    # Walk the spans by start: copy what lies between the reach so far and the next start.
    text = F.col("text")
    state = F.struct(F.lit(0).cast("bigint").alias("reach"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, (s["reach"] + 1).cast("int"), (x["start"] - s["reach"]).cast("int"))
        fresh = F.array_append(s["parts"], F.concat(gap, F.lit(mark)))
        return F.struct(
            F.greatest(s["reach"], x["end"]).alias("reach"),
            F.when(x["start"] >= s["reach"], fresh).otherwise(s["parts"]).alias("parts"),
        )

    done = F.aggregate("live", state, step)
    tail = F.substring(text, (done["reach"] + 1).cast("int"), F.char_length(text))
    clean = F.when(F.col("live").isNull(), text).otherwise(F.concat(F.array_join(done["parts"], ""), tail))
    out = rows.join(live, _same(rows, live), "left").select("row", clean.alias("clean"))
    return out.select(F.col("row").withField(text_col, F.col("clean")).alias("row")).select("row.*")
