"""Metrics of poses (contacts) and structures (coordinates), and contacts from atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.numbers import ratio
from lectern.operators.keys import last_by, with_order
from lectern.operators.large_panels import first_rows


def contact_keys(contacts: Column) -> Column:
    """Distinct (target residue, peptide residue) of a contact list."""
    return F.array_distinct(F.transform(F.coalesce(contacts, F.array()), lambda c: F.struct(c["target_residue"].alias("t"), c["peptide_residue"].alias("p"))))


def sites(site: Column, contacts: Column) -> Column:
    """Binding-site residues, or those of the contacts where none are listed."""
    return F.when(F.coalesce(F.size(site), F.lit(0)) > 0, F.array_distinct(site)).otherwise(F.array_distinct(F.transform(F.coalesce(contacts, F.array()), lambda c: c["target_residue"])))


def evaluate_pose(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: contact precision and recall, site recovery and orientation, averaged over the cases that have contact labels."""
    last = last_by(with_order(predictions).select("benchmark_id", "predicted_contacts", F.col("binding_site_residues").alias("p_site"), F.col("orientation_label").alias("p_orientation"), "ord"), ["benchmark_id"]).drop("ord")
    df = cases.join(last, "benchmark_id")
    gold, pred = contact_keys(F.col("native_contacts")), contact_keys(F.col("predicted_contacts"))
    gold_site, pred_site = sites(F.col("binding_site_residues"), F.col("native_contacts")), sites(F.col("p_site"), F.col("predicted_contacts"))
    hits = F.size(F.array_intersect(gold, pred))
    labelled = F.coalesce(F.size("native_contacts"), F.lit(0)) > 0
    rows = df.select(
        labelled.alias("labelled"),
        ratio(hits, F.size(pred)).alias("precision"),
        ratio(hits, F.size(gold)).alias("recall"),
        ratio(F.size(F.array_intersect(gold_site, pred_site)), F.size(gold_site)).alias("site"),
        F.when(labelled & (F.coalesce("orientation_label", F.lit("")) != "") & (F.coalesce("p_orientation", F.lit("")) != ""), (F.col("orientation_label") == F.col("p_orientation")).cast("int")).alias("orientation"),
    )
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("labelled"), F.col(c))), F.lit(0.0))
    return rows.agg(
        mean("precision").alias("interface_contact_precision"),
        mean("recall").alias("interface_contact_recall"),
        mean("recall").alias("native_contact_recovery"),
        mean("site").alias("binding_site_recovery"),
        F.coalesce(F.avg("orientation"), F.lit(0.0)).alias("peptide_orientation_accuracy"),
        F.count_if("labelled").alias("contact_metric_denominator"),
        F.count_if("labelled").alias("pose_contact_labeled_subset_count"),
        F.count_if(~F.col("labelled")).alias("pose_coordinate_reference_subset_count"),
    )


def rmsd(gold: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_atoms, rmsd) over the atoms that both have, without superposition; frames hold (by, atom_id, x, y, z, ord), the last row of an atom counts."""
    both = last_by(gold, [*by, "atom_id"]).alias("g").join(last_by(pred, [*by, "atom_id"]).alias("p"), [*by, "atom_id"])
    square = sum(((F.col(f"g.{c}") - F.col(f"p.{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n_atoms"), F.sqrt(F.sum(square) / F.count(F.lit(1))).alias("rmsd"))


def _atoms(df: DataFrame, column: str) -> DataFrame:
    return df.select("benchmark_id", F.posexplode(column).alias("ord", "a")).select("benchmark_id", "ord", "a.atom_id", "a.x", "a.y", "a.z")


def evaluate_structure(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: mean RMSD of the cases with shared atoms (null without any), how many were evaluated and skipped."""
    last = last_by(with_order(predictions).select("benchmark_id", "coordinates", "ord"), ["benchmark_id"])
    each = rmsd(_atoms(cases, "gold_coordinates"), _atoms(last, "coordinates"), ["benchmark_id"])
    rows = cases.select("benchmark_id").join(last.select("benchmark_id"), "benchmark_id").join(each, "benchmark_id", "left")
    return rows.agg(F.avg("rmsd").alias("backbone_rmsd"), F.avg("rmsd").alias("all_atom_rmsd"), F.count("rmsd").alias("rmsd_evaluated_cases"), F.count_if(F.col("rmsd").isNull()).alias("rmsd_skipped_count"))


PART = 1024  # atoms of a side that meet at once


def contact_list(found: DataFrame, by: tuple[str, ...], most: int = 200) -> DataFrame:
    """(by, native_contacts): the contacts of each pair of chains as one array, by target residue, the first ``most``; no more than those are gathered."""
    few = first_rows(found, list(by), [F.col("residue"), F.col("other_residue"), F.col("distance")], most)
    one = F.struct(F.col("residue").alias("target_residue"), F.col("other_residue").alias("peptide_residue"), F.col("distance").alias("distance_angstrom"))
    return few.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("native_contacts"))


def _parts(atoms: DataFrame, cell: list[str], name: str, most: int) -> DataFrame:
    """(cell, name): in how many parts the atoms of a crowded cell are dealt; cells of up to ``most`` atoms have no row."""
    return atoms.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name)).where(F.col(name) > 1)


def contacts(left: DataFrame, right: DataFrame, cutoff: float = 5.0, by: tuple[str, ...] = (), part: int = PART) -> DataFrame:
    """(by, residue, other_residue, distance) of residues with two atoms at most ``cutoff`` apart; the least distance, to 3 digits.

    Frames hold (by, residue, x, y, z). Space is cut into cells of the cutoff's
    size: an atom meets only the atoms of its cell and the 26 around it, an
    equi-join instead of all pairs. A cell with more than ``part`` atoms of a side
    is dealt into parts by their digests, and each part of one side meets each of
    the other under a key of its own, so that no task has a crowded cell to itself.
    Repeated atoms count once.
    """
    cell = lambda c: F.floor(F.col(c) / cutoff)
    at = [*by, "cx", "cy", "cz"]
    a = left.select(*by, "residue", *[F.col(c).alias(f"a{c}") for c in "xyz"], *[cell(c).alias(f"c{c}") for c in "xyz"]).distinct()
    around = F.explode(F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip((i, j, k), "ijk", strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    b = right.select(*by, F.col("residue").alias("other_residue"), *[F.col(c).alias(f"b{c}") for c in "xyz"], *[cell(c).alias(f"q{c}") for c in "xyz"]).distinct()
    b = b.select("*", around.alias("d")).select(*by, "other_residue", "bx", "by", "bz", *[(F.col(f"q{c}") + F.col(f"d.{n}")).alias(f"c{c}") for c, n in zip("xyz", "ijk", strict=True)])
    crowds = _parts(a, at, "_m", part).join(_parts(b, at, "_n", part), at, "full")
    one = lambda c: F.coalesce(c, F.lit(1))
    mine, theirs = F.pmod(F.xxhash64("residue", "ax", "ay", "az"), one("_m")).cast("int"), F.pmod(F.xxhash64("other_residue", "bx", "by", "bz"), one("_n")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), one(n) - 1))
    a = a.join(crowds, at, "left").select(*at, "residue", "ax", "ay", "az", mine.alias("_i"), each("_n").alias("_j"))
    b = b.join(crowds, at, "left").select(*at, "other_residue", "bx", "by", "bz", each("_m").alias("_i"), theirs.alias("_j"))
    apart = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2 + (F.col("az") - F.col("bz")) ** 2)
    near = a.join(b, [*at, "_i", "_j"]).withColumn("distance", apart).where(F.col("distance") <= cutoff)
    return near.groupBy(*by, "residue", "other_residue").agg(F.round(F.min("distance"), 3).alias("distance"))


def _copies(atoms: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(residues with all their atoms as one sorted array, the distinct arrays with the least residue that has them and how many do)."""
    members = atoms.groupBy(*by, "residue").agg(F.array_sort(F.collect_set(F.struct("x", "y", "z"))).alias("_shape"))
    return members, members.groupBy(*by, "_shape").agg(F.min(F.struct("residue")).alias("_first"), F.count(F.lit(1)).alias("_n"))


def contact_counts(left: DataFrame, right: DataFrame, cutoff: float = 5.0, by: tuple[str, ...] = (), part: int = PART) -> DataFrame:
    """(by, residue, n, nearest): with how many of the others a residue is in contact, and the least distance; those in contact with none have no row.

    Frames are as ``contacts`` has them. Residues with the same atoms are copies:
    one of them meets the others' and stands for all, so that pairs grow with the
    different sets of atoms and not with the copies.
    """
    (members, mine), (_, theirs) = _copies(left, by), _copies(right, by)
    points = lambda shapes: shapes.select(*by, F.col("_first").alias("residue"), F.explode("_shape").alias("_a")).select(*by, "residue", "_a.x", "_a.y", "_a.z")
    found = contacts(points(mine), points(theirs), cutoff, by, part).withColumnRenamed("residue", "_first")
    sizes = theirs.select(*by, F.col("_first").alias("other_residue"), "_n")
    each = found.join(sizes, [*by, "other_residue"]).groupBy(*by, "_first").agg(F.sum("_n").alias("n"), F.min("distance").alias("nearest"))
    return members.join(mine.join(each, [*by, "_first"]).select(*by, "_shape", "n", "nearest"), [*by, "_shape"]).select(*by, "residue", "n", "nearest")
