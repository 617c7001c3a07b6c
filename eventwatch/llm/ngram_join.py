"""N-gram Jaccard join by prefixes (operator 9).

Documents with the same words in the same order are one class from the start. Classes are indexed under the rare
elements of their prefixes, and classes are paired one by one: classes with equal prefixes are not
grouped. Only connectivity is asked for, so pairs already connected are not looked at
again. First every class is tried against the most central class of its blocks, then against its
nearest candidate in another component, and last all pairs that pass the filters and still lie in two
components are verified: no link between components can remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventwatch.llm import set_join as sj
from eventwatch.llm.text_arrays import Words, id_and_text, slices
from eventwatch.session import materialize

SHINGLE = 4
PERCENT = 85
#: Members of a block one task compares at a time; larger blocks are cut into pairs of such parts.
TILE = 2048


def document_sets(docs: DataFrame, size: int, percent: int, rarity: sj.Rarity | None) -> DataFrame:
    """doc_id, body (hash of the text), key (of the word sequence), and with `rarity` n, prefix and bitmap.

    Only documents with words.
    """
    full = rarity is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets)
                out = [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(sj.sequence_keys(words), pa.binary())]
                names = ["doc_id", "body", "key"]
                if full:
                    sets = sj.shingle_sets(words, size, rarity)
                    out += [pa.array(sets.n, pa.int32()), sets.prefixes(percent), pa.array(sets.bitmaps(), pa.binary())]
                    names += ["n", "prefix", "bitmap"]
                yield pa.RecordBatch.from_arrays(out, names)

    read = id_and_text(docs).withColumn("body", F.xxhash64("text"))
    kind = "doc_id bigint, body bigint, key binary" + (", n int, prefix array<bigint>, bitmap binary" if full else "")
    return read.mapInArrow(run, kind)


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, label): smallest id connected to each id of `edges` (a, b), by min labels and pointer jumps.

    Labels start at `known` (id, label) where given. Each step is written to the shared folder.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    nodes = both.select(F.col("a").alias("id")).distinct()
    if known is not None:
        # connect by labels: the components so far become single nodes
        label = lambda side: F.coalesce(F.col(f"{side}l"), F.col(side))
        la, lb = (known.select(F.col("id").alias(s), F.col("label").alias(f"{s}l")) for s in ("a", "b"))
        merged = components(both.join(la, "a", "left").join(lb, "b", "left").select(label("a").alias("a"), label("b").alias("b")))
        new = merged.select(F.col("id").alias("label"), F.col("label").alias("to"))
        every = known.union(nodes.join(known, "id", "left_anti").select("id", F.col("id").alias("label")))
        return materialize(every.join(new, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
    labels = materialize(nodes.select("id", F.col("id").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels.id == near.a, "left").select("id", F.least("label", F.coalesce("near", "label")).alias("step"), "label")
        stepped = materialize(stepped, "labels")
        jump = stepped.select(F.col("id").alias("step"), F.col("step").alias("further"))
        jumped = stepped.join(jump, "step", "left").select("id", F.least("step", F.coalesce("further", "step")).alias("label"), F.col("label").alias("old"))
        done = materialize(jumped, "labels")
        labels = done.select("id", "label")
        if done.filter("label <> old").isEmpty():
            return labels


def blocks(reps: DataFrame) -> DataFrame:
    """(token, id, n, pos): prefix elements that several classes share."""
    tokens = reps.select("id", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "id", "n", "pos")
    return materialize(sj.shared_elements(tokens), "blocks")


def central_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Each id with the hub it shares most prefix elements with; a hub has its element earliest."""
    hub = rows.groupBy("token").agg(F.min(F.struct("pos", "id", "n")).alias("hub"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    met = rows.join(hub.select("token", "hub"), "token").filter("id <> hub.id").filter(
        (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")))
    each = met.groupBy("id", F.col("hub.id").alias("other")).agg(F.count(F.lit(1)).alias("shared"))
    best = each.groupBy("id").agg(F.max(F.struct("shared", "other")).alias("m"))
    return best.select(F.least("id", "m.other").alias("a"), F.greatest("id", "m.other").alias("b")).distinct()


def _other_component(table: pa.Table):
    label = table["label"].to_numpy()

    def wanted(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = label[i] != label[j]
        return np.r_[i[ok], j[ok]], np.r_[j[ok], i[ok]]

    return wanted


def next_pairs(rows: DataFrame, reps: DataFrame, labels: DataFrame, percent: int, best: bool) -> DataFrame:
    """(a, b): candidates in two components; per id only the nearest by bitmaps with `best`."""
    marked = rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = marked.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("held"))
    mixed = mixed.filter("lo <> hi").select("token", F.ceil(F.col("held") / TILE).cast("int").alias("parts"))
    use = marked.join(mixed, "token").join(reps.select("id", "bitmap"), "id")
    found = sj.paired(use, percent, _other_component, best)
    return found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def link_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    component_id is the smallest doc_id reachable over links (Jaccard percent/100 or more). Null, empty
    and wordless texts have no shingles and are alone. Repeated rows give repeated results. A null
    doc_id is kept and is the component_id only where its component has no other id. Other columns are
    ignored; an empty table gives no rows.
    """
    return linked(docs, size, percent).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, all their columns, of the first document of each component.

    That is the one with the smallest doc_id (then hash of the text); of identical rows one stays.
    Rows without words are in no component and all stay.
    """
    names, texts = docs.columns, F.coalesce(F.col("text"), F.lit(""))
    rows = linked(docs, size, percent)
    kept = rows.filter((F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("body") == F.col("component_body"))))
    kept = materialize(kept.groupBy("doc_id", "body").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")), "kept")
    mine = docs.withColumn("__body", F.xxhash64(texts))
    keys = kept.select(F.col("doc_id").alias("__d"), F.col("body").alias("__b"))
    out = mine.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.col("__body") == F.col("__b")), "left_semi")
    if not kept.filter("copies > 1 and n > 0").isEmpty():
        some = F.length(F.regexp_replace(texts, r"[\x20\x09-\x0D]", "")) > 0
        out = out.filter(some).dropDuplicates(["doc_id", "__body"]).unionByName(out.filter(~some))
    return out.select(*names)


def linked(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, body, n, component_id, component_body for every row; see link_components."""
    rarity = sj.word_rarity(docs)
    sets = document_sets(docs, size, percent, rarity).filter("n > 0")
    classes = sets.groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "body")).alias("first"), F.first("n").alias("n"),
        F.first("prefix").alias("prefix"), F.first("bitmap").alias("bitmap"))
    reps = materialize(classes.select(
        F.monotonically_increasing_id().alias("id"), "key", F.col("first.doc_id").alias("doc_id"), F.col("first.body").alias("body"),
        "n", "prefix", "bitmap"), "classes")
    rows = blocks(reps)
    wanted = rows.select("id").distinct().join(reps.select("id", "doc_id", "body"), "id")
    read = sj.packed(id_and_text(docs).select("doc_id", F.xxhash64("text").alias("body"), "text"))
    same = F.col("w.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("w.body") == F.col("d.body"))
    texts = sj.stored_texts(read.alias("d").join(wanted.alias("w"), same).select("w.id", "d.blob"))
    pairs = materialize(central_pairs(rows, percent), "pairs")
    labels, tested = None, None
    for step in ("best", "all", "done"):
        good = materialize(sj.jaccard_of_texts(pairs, texts, size, percent), "links")
        labels = components(good, labels)
        tested = pairs if tested is None else tested.union(pairs)
        if step == "done":
            break
        found = next_pairs(rows, reps, labels, percent, step == "best")
        pairs = materialize(found.join(tested, ["a", "b"], "left_anti"), "pairs")
    members = document_sets(docs, size, percent, None)
    rep = reps.select("key", "id", "n", "doc_id", "body").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("component_id"), F.col("body").alias("component_body")))
    named = rep.join(rep.groupBy("label").agg(first.alias("first")), "label").select("key", "n", "first.component_id", "first.component_body")
    alone = F.col("n").isNull()
    return members.join(named, "key", "left").select(
        "doc_id", "body", F.coalesce("n", F.lit(0)).alias("n"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("body")).otherwise(F.col("component_body")).alias("component_body"))
