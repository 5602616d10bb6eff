"""Column by column: present on both sides, same family, same null count."""

from __future__ import annotations

from pyspark.sql import DataFrame

from concordat.functions.sql import aggregate, literal, quoted, struct, unpivot
from concordat.functions.types import family
from concordat.operators.pairing import FROM_SOURCE, FROM_TARGET, align


def structural_report(source: DataFrame, target: DataFrame) -> DataFrame:
    """(column, positions, families, source_nulls, target_nulls, names_match, family_match,
    nulls_match); positions, families and nulls are null where a side lacks the column.
    Everything but the null counts is metadata; those are one job over both sides."""
    pair = align(source, target)
    where = [{f.name: (i, family(f.dataType)) for i, f in enumerate(df.schema.fields)} for df in (source, target)]
    counts, rows = {"rows": "count(1)"}, []
    for i, name in enumerate(sorted(where[0].keys() | where[1].keys())):
        (sp, sf), (tp, tf) = (side.get(name, (None, None)) for side in where)
        both = sp is not None and tp is not None
        if both:
            for tag, side in (("s", FROM_SOURCE), ("t", FROM_TARGET)):
                counts[f"{tag}{i}"] = f"count_if({quoted(name)} IS NULL AND {side})"
        number = lambda v: "CAST(NULL AS int)" if v is None else str(v)
        rows.append(
            struct(
                column=literal(name),
                source_position=number(sp),
                target_position=number(tp),
                source_family=f"CAST({literal(sf)} AS string)",
                target_family=f"CAST({literal(tf)} AS string)",
                source_nulls=f"s{i}" if both else "CAST(NULL AS bigint)",
                target_nulls=f"t{i}" if both else "CAST(NULL AS bigint)",
            )
        )
    return unpivot(aggregate(pair.tagged(), [], counts), [], rows).selectExpr(
        "*",
        "source_position IS NOT NULL AND target_position IS NOT NULL AS names_match",
        "coalesce(source_family = target_family, false) AS family_match",
        "coalesce(source_nulls = target_nulls, false) AS nulls_match",
    )
