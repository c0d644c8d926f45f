"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases.

Leaves are phrases of a paragraph (cut after punctuation, and at 40 code points), paragraphs are lines, and a section
ends before a blank line or before a paragraph whose digest says so, so that an edit never moves distant borders.
Every node is the SHA-256 of its children's digests: equal roots mean equal texts, and where roots differ the
differing sections, paragraphs and phrases are where the edits are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accountscope.llm.common import let, or_empty, shuffle_partitions

LEAF = r"[^.,;:!?]{1,40}[.,;:!?]*|[.,;:!?]+"
#: Paragraph digests that start a section: 2 of 16 first digits, so about eight paragraphs to a section.
SECTION_START = "^[01]"
#: Hexadecimal digits of a leaf that the fingerprint keeps.
CODE = 6


def merkle(text: Column) -> Column:
    """``struct(root, tree, leaves)`` of a text; NULL counts as empty.

    root: 64 hexadecimal digits. tree: sections joined by ``/``, each its digest, ``=`` and its paragraphs joined by
    ``,``, each the first digits of its digest, a dot and the first digits of its leaves. leaves: those of the whole text in order, as 64-bit hashes of whole digests.
    """

    def paragraph(p: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(p, F.lit(LEAF), 0), lambda x: F.sha2(x, 256))
        return let(leaves, lambda xs: F.struct(
            F.sha2(F.array_join(xs, ""), 256).alias("digest"),
            F.array_join(F.transform(xs, lambda x: F.substring(x, 1, CODE)), "").alias("codes"),
            F.transform(xs, lambda x: F.xxhash64(x)).alias("leaves"),
            (F.size(xs) == 0).alias("blank"),
        ))

    def node(x: Column) -> Column:
        border = F.when(x["blank"] | x["digest"].rlike(SECTION_START), "/").otherwise(",")
        return F.concat(border, x["digest"], F.lit("."), x["codes"])

    def short(section: Column) -> Column:
        return F.regexp_replace(section, r"([0-9a-f]{8})[0-9a-f]{56}\.", "$1.")

    def sections(ps: Column) -> Column:
        return F.split(F.substring(F.array_join(F.transform(ps, node), ""), 2, 2**31 - 1), "/")

    def assemble(ps: Column) -> Column:
        hashed = F.transform(sections(ps), lambda s: F.struct(F.sha2(s, 256).alias("digest"), short(s).alias("nodes")))
        return let(hashed, lambda ss: F.struct(
            F.sha2(F.array_join(F.transform(ss, lambda s: s["digest"]), ""), 256).alias("root"),
            F.array_join(F.transform(ss, lambda s: F.concat(F.substring(s["digest"], 1, 16), F.lit("="), s["nodes"])),
                         "/").alias("tree"),
            F.flatten(F.transform(ps, lambda p: p["leaves"])).alias("leaves"),
        ))

    return let(F.transform(F.split(or_empty(text), "\n"), paragraph), assemble)


def fingerprint(tree: Column) -> Column:
    """The string form of a Merkle tree."""
    return F.concat(tree["root"], F.lit(":"), tree["tree"])


def likeness(a: Column, b: Column) -> Column:
    """Share of distinct leaves in common (Dice), 0 to 1: 1 exactly where roots are equal."""
    both = F.size(F.array_intersect(a["leaves"], b["leaves"])) * 2.0
    total = F.size(F.array_distinct(a["leaves"])) + F.size(F.array_distinct(b["leaves"]))
    return F.when(a["root"] == b["root"], 1.0).when(total == 0, 0.0).otherwise(F.least(both / total, F.lit(0.999999)))


def changed_sections(a: Column, b: Column) -> Column:
    """Sections of fingerprint string ``a`` that fingerprint string ``b`` lacks: the branches that hold the edits."""
    def parts(x: Column) -> Column:
        return F.split(F.substring(x, 66, 2**31 - 1), "/")

    return F.array_except(parts(a), parts(b))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_partition: int = 8) -> DataFrame:
    """``id, text, tree, next_text, next_tree``: every document beside the next one by descending id, cyclically.

    Ids are cut into ranges at quantiles. Each range is sorted by itself, and the first document of a range also goes
    to the range before it: one shuffle of the texts, no global sort. Ids are integers. Equal ids are ordered by a hash
    of the text; NULL ids come last, in ranges of that hash. One document is its own successor. Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), or_empty(text_col).alias("text"))
    own = own.withColumn("hash", F.xxhash64("text"))
    n = shuffle_partitions(spark) * per_partition
    found = own.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    cuts = sorted(set(found or []))
    step = max(1, int(len(cuts) ** 0.5))
    fine = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    last = [c[-1] for c in fine]

    def below(values: Column, x: Column) -> Column:
        return F.size(F.filter(values, lambda c: c < x))

    bucket = F.lit(0)
    if cuts:  # two-level search: first the group of cuts, then the cut
        groups, ends = F.lit([list(map(int, f)) for f in fine]), F.lit(list(map(int, last)))
        bucket = let(below(ends, F.col("id")), lambda g: g * step + F.coalesce(
            below(F.get(groups, g), F.col("id")), F.lit(0)))
    # Rows without an id are in ranges of their own below all others, by the first bits of the hash.
    part = F.shiftright("hash", 48).cast("int") + (1 << 15)
    nameless = -1 - F.floor(part * F.lit(n) / (1 << 16))
    placed = own.withColumn("bucket", F.when(F.col("id").isNull(), nameless).otherwise(bucket).cast("int"))

    # The first document of each range, a row per range, also belongs to the range above (ids descend).
    first = F.min(F.struct(F.bitwise_not("id").alias("down"), "id", "hash")).alias("head")
    heads = placed.groupBy("bucket").agg(first).collect()
    order = sorted(heads, key=lambda r: -r["bucket"])
    also = [(r["head"]["id"], r["head"]["hash"], r["bucket"], order[i - 1]["bucket"]) for i, r in enumerate(order)]
    goes = spark.createDataFrame(also, "head bigint, head_hash bigint, own int, above int")
    is_head = placed["id"].eqNullSafe(goes["head"]) & (placed["hash"] == goes["head_hash"])
    joined = placed.join(F.broadcast(goes), is_head & (placed["bucket"] == goes["own"]), "left")
    here = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    there = F.struct(F.col("above").alias("bucket"), F.lit(True).alias("guest"))
    targets = F.when(F.col("above").isNull(), F.array(here)).otherwise(F.array(here, there))
    dealt = joined.select("id", "text", "hash", F.explode(targets).alias("to")).select("id", "text", "hash", "to.bucket", "to.guest")
    trees = dealt.repartition(shuffle_partitions(spark), "bucket").withColumn("tree", merkle(F.col("text")))
    w = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc_nulls_last(), "hash", "text")
    return (
        trees.select("id", "text", "tree", "guest", F.lead("text").over(w).alias("next_text"),
                     F.lead("tree").over(w).alias("next_tree"))
        .where(~F.col("guest")).drop("guest")
    )


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has its last half replaced by the start of the next document. NULL text counts as empty.
    """
    pairs = with_next(docs, id_col, text_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    out = pairs.withColumn("edited", edited).withColumn("edited_tree", merkle(F.col("edited")))
    return out.select(
        F.col("id").alias(id_col),
        n.cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("tree")).alias("fingerprint"),
        fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
    )
