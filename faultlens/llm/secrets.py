"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates of three kinds are found with their places: the text between the matches of a pattern and the matches
themselves, added up. Hashes of the candidate values are then counted by distinct sources (owners) and documents
(repositories). A value that many owners or many repositories share gets a further span of kind ``shared``, any other
one of kind ``live``, or ``placeholder`` if it looks made up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.session import stage

# Kinds in their order, patterns, the group that holds the value and its least length.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 16),
    "hex": (r"([0-9a-f]{32,})", 1, 32),
}
#: Values of at least this many owners, or repositories of any owners, count as copied examples.
SHARED_OWNERS, SHARED_REPOSITORIES = 3, 50
#: A value of less entropy than this per character, over its own characters, counts as made up.
LEAST_ENTROPY = 2.5
# Words that made-up values hold.
PLACEHOLDER_WORDS = ["changeme", "default", "dummy", "example", "password", "placeholder", "redacted", "sample", "secret", "test", "your", "xxxx", "123456"]


def _spans(text: Column, kind: str) -> Column:
    pattern, group, least = KINDS[kind]
    quoted = F.lit(pattern)
    whole, value = F.regexp_extract_all(text, quoted, F.lit(0)), F.regexp_extract_all(text, quoted, F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("all"), value.alias("value"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>").alias("out"))

    def add(done, part):
        start = done["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["all"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), part["value"].alias("value"))
        hit = F.coalesce(F.length(part["value"]) >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(hit, F.concat(done["out"], F.array(span))).otherwise(done["out"]).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(parts, begin, add, lambda done: done["out"])).otherwise(
        F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>"))


def looks_live(value: Column) -> Column:
    """Whether a value could be a credential: letters and digits, no word of examples, and entropy enough.

    Letters alone are words or names, digits alone numbers; keys are drawn from both. The entropy is that of the
    characters of the value itself.
    """
    lower = F.lower(value)
    size = F.length(value).cast("double")
    share = lambda c: (size - F.length(F.replace(value, c, F.lit("")))) / size
    entropy = F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0),
                          lambda s, c: s - F.when(F.length(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]") & ~lower.rlike("|".join(PLACEHOLDER_WORDS)) & (entropy >= LEAST_ENTROPY)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """``(row, doc_id, owner, found)``: base spans of each whole text by start, then kind as listed; null texts have none.

    Places are code points, ends exclusive. Texts without a span stay with an empty array.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.create_map(*[F.lit(v) for at, kind in enumerate(KINDS) for v in (kind, at)])
    found = F.concat(*[_spans(text, kind) for kind in KINDS])
    ranked = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("nth"),
                                                                 s["end"].alias("end"), s["kind"].alias("kind"),
                                                                 F.sha2(s["value"], 256).alias("value"),
                                                                 looks_live(s["value"]).alias("credible"),
                                                                 F.length(s["value"]).alias("size"))))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                       F.col(owner_col).alias("owner"), ranked.alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """``(value, owners, repositories)`` per candidate hash, counted over the whole corpus.

    Repeats within a document and an owner are merged before the shuffle. A null owner or id counts as none.
    """
    each = found.select("doc_id", "owner", F.explode("found").alias("s")).select("doc_id", "owner", F.col("s.value").alias("value"))
    once = each.groupBy("value", "owner", "doc_id").agg(F.lit(1).alias("one"))
    repositories = once.groupBy("value", "doc_id").agg(F.lit(1).alias("one")).groupBy("value").agg(F.count("doc_id").alias("repositories"))
    owners = once.groupBy("value", "owner").agg(F.lit(1).alias("one")).groupBy("value").agg(F.count("owner").alias("owners"))
    return owners.join(repositories, "value")


def scan(docs: DataFrame, shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES) -> DataFrame:
    """``(doc_id, found, judged)`` per row of ``docs``; judged adds ``owners``, ``repositories`` and the verdict to each span.

    A ``shared`` value has ``shared_owners`` owners or ``shared_repositories`` repositories: what one owner pasted into
    very many documents is an example as well. Of the others, those that look like a credential are ``live``, the rest
    is ``placeholder``.

    Empty texts, null texts and texts without candidates give empty arrays; repeated rows stay apart; extra columns are
    ignored; an empty table gives an empty result.
    """
    found = stage(candidates(docs), "candidates")
    some = found.where(F.size("found") > 0)
    counts = stage(ownership(some), "ownership")
    each = some.select("row", F.explode("found").alias("s")).withColumn("value", F.col("s.value"))
    judged = each.join(counts, "value").withColumn(
        "verdict", F.when((F.col("owners") >= shared_owners) | (F.col("repositories") >= shared_repositories), "shared")
        .when(F.col("s.credible"), "live").otherwise("placeholder")).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("s.start", "s.nth", "s.end", "s.kind", "s.size", "owners", "repositories", "verdict"))).alias("judged"))
    kind = judged.schema["judged"].dataType.simpleString()
    return found.join(judged, "row", "left").select("doc_id", "found", F.coalesce("judged", F.array().cast(kind)).alias("judged"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def digest(scanned: DataFrame) -> DataFrame:
    """The registered result: counts, the hash of the base spans, and all spans including the verdicts on the values.

    A verdict's span covers the value, which ends where its base span ends.
    """
    def text(kind, start, end):
        return F.concat_ws(":", kind, start.cast("string"), end.cast("string"))
    base = F.transform("found", lambda s: text(s["kind"], s["start"], s["end"]))
    # Base spans come first at equal starts: their kinds are numbered 0 to 2, the verdicts 3.
    both = F.array_sort(F.concat(
        F.transform("judged", lambda s: F.struct(s["start"].alias("start"), s["nth"].alias("nth"), s["end"].alias("end"), s["kind"].alias("kind"))),
        F.transform("judged", lambda s: F.struct((s["end"] - s["size"]).alias("start"), F.lit(3).alias("nth"), s["end"].alias("end"), s["verdict"].alias("kind")))))
    count = {f"n_{k}": F.size(F.filter("found", _of_kind(k))).cast("long") for k in KINDS}
    return scanned.select("doc_id", *[c.alias(n) for n, c in count.items()], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
                          F.array_join(F.transform(both, lambda s: text(s["kind"], s["start"], s["end"])), ",").alias("spans"))
