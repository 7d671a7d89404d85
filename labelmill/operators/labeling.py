"""Label vectors, roll-up to coarse labels, openness and label frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.functions.labelsets import SECTIONS, LabelSet


def encode(names: Column, labels: LabelSet) -> Column:
    """0/1 vector in label order. Unknown names are dropped, repeated names count once."""
    return F.transform(
        labels.literal(), lambda name: F.coalesce(F.array_contains(names, name), F.lit(False)).cast("int"))


def decode(vector: Column, labels: LabelSet) -> Column:
    """Names of the positions that hold exactly 1."""
    named = F.arrays_zip(labels.literal().alias("name"), vector.alias("value"))
    return F.transform(F.filter(named, lambda e: e["value"] == 1), lambda e: e["name"])


#: Labels that one mask holds; the sign bit is left alone.
BITS = 63


def mask_of(name: Column, labels: LabelSet, word: int = 0) -> Column:
    """Bit of a label name in the mask numbered `word`, 0 if it has none there.

    `bit_or` over rows builds a label set; a vocabulary of more than 63 labels takes several masks.
    """
    bit = F.lit(0).cast("bigint")
    for i, label in reversed(list(enumerate(labels.labels[BITS * word:BITS * (word + 1)]))):
        bit = F.when(name == label, F.lit(1 << i).cast("bigint")).otherwise(bit)
    return bit


def n_masks(labels: LabelSet) -> int:
    return -(-len(labels.labels) // BITS)


def unmask(masks: Column | list[Column], labels: LabelSet) -> Column:
    """0/1 vector from the masks of a vocabulary, or from its only one; null counts as no label."""
    words = masks if isinstance(masks, list) else [masks]
    if len(words) != n_masks(labels):
        raise ValueError(f"{len(labels.labels)} labels take {n_masks(labels)} masks")
    return F.array(*[
        F.shiftright(F.coalesce(words[i // BITS], F.lit(0).cast("bigint")), i % BITS)
        .bitwiseAND(F.lit(1).cast("bigint")).cast("int") for i in range(len(labels.labels))])


def only_open(names: Column, labels: LabelSet) -> Column:
    """The work's labels that are open, order kept. Names outside the label set drop out."""
    wanted = F.array(*[F.lit(n) for n in labels.labels if n in labels.open_labels])
    return F.filter(names, lambda n: F.array_contains(wanted, n))


def only_closed(names: Column, labels: LabelSet) -> Column:
    wanted = F.array(*[F.lit(n) for n in labels.closed_labels])
    return F.filter(names, lambda n: F.array_contains(wanted, n))


def rollup(unit_labels: DataFrame, labels: LabelSet, unit: list[str], label: str = "label") -> DataFrame:
    """Distinct fine labels per unit and coarse label; labels without a coarse one drop out.

    The labels of a unit fold to bit masks inside each task, so repeated labels never reach the
    shuffle, and there is only one. Counting bits per coarse label needs no join.
    """
    words = range(n_masks(labels))
    members: dict[str, list[int]] = {}
    for i, name in enumerate(labels.labels):
        if name in labels.coarse_of:
            members.setdefault(labels.coarse_of[name], [0] * len(words))[i // BITS] |= 1 << i % BITS

    def held(bits: list[int]) -> Column:
        return sum((F.bit_count(F.col(f"_mask{w}").bitwiseAND(F.lit(bits[w]).cast("bigint"))).cast("bigint")
                    for w in words), F.lit(0).cast("bigint"))

    counted = F.array(*[F.struct(F.lit(coarse).alias("coarse"), held(bits).alias("fine_labels"))
                        for coarse, bits in members.items()])
    masks = [F.bit_or(mask_of(F.col(label), labels, w)).alias(f"_mask{w}") for w in words]
    return (
        unit_labels.groupBy(*unit).agg(*masks)
        .select(*unit, F.inline(counted)).filter(F.col("fine_labels") > 0)
    )


def unmapped(unit_labels: DataFrame, labels: LabelSet, label: str = "label") -> DataFrame:
    """Label names outside the vocabulary and how often they occur."""
    known = labels.dim(unit_labels.sparkSession).select(F.col("label").alias(label))
    return (unit_labels.groupBy(label).agg(F.count("*").alias("rows"))
            .join(F.broadcast(known), label, "left_anti"))


def frequency(label_rows: DataFrame, labels: LabelSet, label: str = "label") -> DataFrame:
    """Count, rank and frequency third of each label of the vocabulary that occurs, ties by name.

    The ranking window runs over one row per label, after the counting: never over free names.
    """
    known = label_rows.filter(F.col(label).isin(labels.labels))
    counts = known.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.col("n").desc(), F.col("label"))
    third = F.ntile(len(SECTIONS)).over(order)
    names = F.array(*[F.lit(s) for s in SECTIONS])
    return counts.select(
        "label", "n", F.row_number().over(order).alias("freq_rank"),
        F.element_at(names, third).alias("section"))
