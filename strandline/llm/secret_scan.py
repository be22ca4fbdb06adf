"""Secret scans by corpus-wide ownership frequency, in DataFrame functions alone.

Expressions propose spans.  The hashes of their values are counted over the whole
corpus by distinct repositories and owners: a value that many owners hold is a
widely copied example, one that a single owner holds and that looks random is
reported as live.

One pass over the texts finds the spans and writes them, without the texts, to
the shared folder; counting and joining read that narrow table.  Counts are
aggregated by (value, repository, owner) before they meet, so a value that a
third of all texts hold is a row per repository and owner; its spans' side of
the join back is dealt by value and split by adaptive execution.

A value in several repositories of one owner is that owner's alone, and so may be
live; a value in one repository each of several owners is an example that went
around.  In `documents` the owner is the source, and a source's documents of one
language are a repository.

Defined cases: a null or empty text has no spans; a null repository or owner
counts as one of its own name; repeated rows each have their row in the result;
other columns of the table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import common, spans

#: Kinds of the contract, then those that the method adds, in the order of `kind`.
KINDS = ["assign", "access", "hex", "github", "slack", "jwt", "pem", "secretkey"]
BASE = 3
#: A value that at least this many owners hold is a widely copied example.
COPIED_OWNERS = 3
#: A value of one or two owners looks live from this length and number of different characters on.
LIVE_LENGTH, LIVE_CHARACTERS = 16, 8

ASSIGN = """((?i:password|passwd|secret|token|api_?key))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ADDED = {
    3: ("gh", "gh[pousr]_[A-Za-z0-9]{36,}+"),
    4: ("xox", "xox[abprs]-[A-Za-z0-9-]{10,}+"),
    5: ("eyJ", "eyJ[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+"),
    6: ("PRIVATE KEY", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    7: ("sk", "sk[-_](?:live_|test_|proj-)?[A-Za-z0-9]{20,}+"),
}


def find_spans(text):
    """All spans of a text, by start and then kind."""
    # A failing assignment still takes its place among the matches, so length is tested after matching.
    assign = F.filter(spans.find(text, text.rlike("(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]"), ASSIGN, 0, 2), lambda s: F.length(s["part"]) >= 6)
    access = spans.find(text, text.contains("AKIA"), "AKIA[A-Z0-9]{16,}+", 1)
    hexes = spans.find(text, text.rlike("[0-9a-f]{24}"), "[0-9a-f]{24,}+", 2)
    added = [spans.find(text, text.contains(hint) & text.rlike(rx), rx, kind) for kind, (hint, rx) in ADDED.items()]
    return spans.sorted_by(F.concat(assign, access, hexes, *added), "start", "kind")


def scan(docs: DataFrame, repository: str | Column = "source", owner: str | Column = "source") -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, and how many spans hold copied and live-looking values.

    repository, owner: columns of docs, by name or as expressions; repositories of
    the same name count apart if their owners differ.
    """
    repository, owner = (F.coalesce((common.column(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in (repository, owner))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(
        F.col("doc_id"), repository.alias("repository"), owner.alias("owner"), find_spans(text).alias("found")
    )
    slim = F.transform(
        "found",
        lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.sha2(s["part"], 256).alias("value"),
            ((F.length(s["part"]) >= LIVE_LENGTH) & (F.size(F.array_distinct(F.split(s["part"], ""))) >= LIVE_CHARACTERS) & ~s["part"].contains("EXAMPLE")).alias("random"),
        ),
    )
    found = common.written(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repository", "owner", slim.alias("found")), "secrets")
    held = found.where(F.size("found") > 0).select("row", "repository", "owner", F.explode("found").alias("s")).select("row", "repository", "owner", "s.value", "s.random")
    per_place = held.groupBy("value", "repository", "owner").agg(F.count(F.lit(1)).alias("n"))
    per_owner = per_place.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    counts = per_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("occurrences"))
    ownership = common.written(counts, "ownership")
    per_row = held.join(ownership, "value").groupBy("row").agg(
        F.count_if(F.col("owners") >= COPIED_OWNERS).alias("n_copied"),
        F.count_if((F.col("owners") < COPIED_OWNERS) & F.col("random")).alias("n_live"),
        F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"),
    )
    base = F.filter("found", lambda s: s["kind"] < BASE)
    out = found.join(per_row, "row", "left")
    return out.select(
        "doc_id", *[spans.count(F.col("found"), i).alias(f"n_{KINDS[i]}") for i in range(BASE)], F.sha2(spans.joined(base, KINDS), 256).alias("base_sha256"), spans.joined(F.col("found"), KINDS).alias("spans"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_copied", "n_live", "most_owners", "most_repositories")],
    )


def op8(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return scan(docs, repository=F.concat_ws("/", "source", "lang"), owner="source")
