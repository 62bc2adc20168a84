"""Airport documents, airport defaults and the airport upsert."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.components import components
from skyloom.operators.dedupe import first_per_key
from skyloom.schemas import AIRPORT, AIRPORT_DEFAULTS, AIRPORT_PATHS
from skyloom.session import materialise

_DOC_KEYS = ["ingest_seq", "doc_id"]


def build_airport(docs: DataFrame) -> DataFrame:
    """Flatten airport documents (a VARIANT column ``doc``) and list each one's ``missing`` columns.

    A field that is present but null counts as present, as it does when the JSON is flattened, and so do the fields of
    a null ``country`` or ``continent``; only an absent one is missing. Keep the rows to load with ``accepted_airports``.
    """

    def stored(name: str, path: str) -> Column:
        kind = AIRPORT[name].dataType.simpleString()
        return F.try_variant_get("doc", f"$.{path}", kind).alias(name)

    def absent(name: str, path: str) -> Column:
        there = F.variant_get("doc", f"$.{path}", "variant").isNotNull()
        if "." in path and path.split(".")[0] == name:  # a null object flattens to a column of its own name
            there = there | F.coalesce(F.is_variant_null(F.variant_get("doc", f"$.{name}", "variant")), F.lit(False))
        return F.when(~there, F.lit(name))

    missing = F.array_compact(F.array(*[absent(*item) for item in AIRPORT_PATHS.items()]))
    return docs.select(
        *_DOC_KEYS,
        *[stored(*item) for item in AIRPORT_PATHS.items()],
        F.lower(F.try_variant_get("doc", "$.country.code", "string")).alias("country_code"),
        missing.alias("missing"),
    )


def accepted_airports(airports: DataFrame) -> DataFrame:
    """The airports with no missing column."""
    return airports.filter(F.size("missing") == 0)


def rejected_airports(airports: DataFrame) -> DataFrame:
    """The airports to skip, with the list of what they lack."""
    return airports.filter(F.size("missing") > 0)


def airport_defaults(spark: SparkSession) -> DataFrame:
    """The built-in defaults, as literals whose size the planner knows."""
    names = ["iata", "icao", "name", "country_code"]
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in AIRPORT_DEFAULTS]
    return spark.range(1).select(F.inline(F.array(*rows)))


def extend_airport_defaults(defaults: DataFrame, airports: DataFrame) -> DataFrame:
    """Add the airports that ``defaults`` does not know, the first document of each.

    A missing ICAO or country code becomes empty text and a missing name the IATA code.
    """
    order = [F.col(c).asc_nulls_first() for c in _DOC_KEYS]
    first = first_per_key(airports.filter(F.col("iata_code").isNotNull()), ["iata_code"], order)
    new = first.select(
        F.col("iata_code").alias("iata"),
        F.coalesce("icao_code", F.lit("")).alias("icao"),
        F.coalesce("name", "iata_code").alias("name"),
        F.coalesce("country_code", F.lit("")).alias("country_code"),
    ).join(defaults.select("iata"), "iata", "left_anti")
    return defaults.unionByName(new)


def upsert_airports(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``existing`` after loading ``incoming`` in document order.

    A row whose IATA code, or else ICAO code, is already stored replaces the seven other columns of
    that row; its own codes are dropped. Any other row is inserted, and the rows after it in the same
    batch match against it too. NULL codes never match.

    Documents are first reduced to one row per code pair. A pair that matches no stored row and shares its codes with no
    other pair is inserted. What is left contradicts itself about which codes belong together: such pairs are gathered by
    the codes that connect them, and each connected group is replayed in document order. The work and the tables written do not
    depend on how long such a chain is.
    """
    keys, values = AIRPORT.names[:2], AIRPORT.names[2:]
    coded = F.coalesce(*keys).isNotNull()

    pairs = (
        incoming.filter(coded)
        .groupBy(*keys)
        .agg(
            F.min(F.struct(*_DOC_KEYS)).alias("doc"),
            F.max(F.struct(*_DOC_KEYS, *values)).alias("latest"),
        )
        .withColumn("place", F.struct("doc", *keys))
        .drop("doc")
    )
    stored = existing.filter(coded).select(*keys)
    settled = materialise(_settle(materialise(_match_by_code(pairs, stored))))

    updates = settled.groupBy("target").agg(F.max("latest").alias("latest"))
    rows = existing.select(*AIRPORT.names).unionByName(
        settled.filter("founds").select(*keys, "latest.*").select(*AIRPORT.names))
    updated = rows.join(
        updates,
        F.col("icao_code").eqNullSafe(F.col("target.icao_code"))
        & F.col("iata_code").eqNullSafe(F.col("target.iata_code")),
        "left",
    ).select(
        *keys,
        *[F.when(F.col("latest").isNotNull(), F.col(f"latest.{c}")).otherwise(F.col(c)).alias(c) for c in values],
    )
    return updated.unionByName(incoming.filter(~coded).select(*AIRPORT.names))


def _settle(pairs: DataFrame) -> DataFrame:
    """``pairs`` with a ``target`` for all, and ``founds`` where a pair is that target's first row."""
    keys = AIRPORT.names[:2]
    matched = pairs.filter("target IS NOT NULL").withColumn("founds", F.lit(False))
    new = pairs.filter("target IS NULL").drop("target")
    for key in keys:
        uses = new.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(f"uses_{key}"))
        new = new.join(uses, key, "left")
    shared = F.greatest(*[F.coalesce(f"uses_{key}", F.lit(0)) for key in keys]) > 1
    new = materialise(new.select(*pairs.drop("target").columns, shared.alias("shared")))
    codes = F.struct("icao_code", "iata_code")
    plain = new.filter("NOT shared").drop("shared").withColumns({"target": codes, "founds": F.lit(True)})

    # One node for each code; a pair with one code only is that code's node alone.
    node = {key: F.concat(F.lit(f"{key[:4]}:"), F.col(key)) for key in keys}
    disputed = new.filter("shared").drop("shared").withColumn("node", F.coalesce(*node.values()))
    edges = disputed.select("node", F.coalesce(*reversed(node.values())).alias("other")).toDF("a", "b")
    grouped = disputed.join(components(edges), "node").select("component", "place", *keys)
    decided = grouped.groupBy("component").applyInPandas(
        _replay, "icao_code string, iata_code string, target struct<icao_code:string,iata_code:string>, founds boolean")
    same = [F.col(f"p.{key}").eqNullSafe(F.col(f"d.{key}")) for key in keys]
    replayed = disputed.drop("node").alias("p").join(decided.alias("d"), same).select("p.*", "d.target", "d.founds")
    return matched.unionByName(plain).unionByName(replayed)


def _replay(group: pd.DataFrame) -> pd.DataFrame:
    """The pairs of one connected group, one after the other: each finds a row by its IATA code, or else ICAO code, or founds one."""
    rows = sorted(zip(group["place"], group["icao_code"], group["iata_code"]), key=lambda row: _order(row[0]))
    by_iata: dict[str, tuple] = {}
    by_icao: dict[str, tuple] = {}
    out = []
    for _, icao, iata in rows:
        target = (by_iata.get(iata) if iata is not None else None) or (by_icao.get(icao) if icao is not None else None)
        founds = target is None
        if founds:
            target = (icao, iata)
            if icao is not None:
                by_icao[icao] = target
            if iata is not None:
                by_iata[iata] = target
        out.append((icao, iata, {"icao_code": target[0], "iata_code": target[1]}, founds))
    return pd.DataFrame(out, columns=["icao_code", "iata_code", "target", "founds"])


def _order(place) -> list:
    """A place as Spark orders it: document, then codes; NULL first."""
    parts = [*(place["doc"][key] for key in _DOC_KEYS), *(place[key] for key in AIRPORT.names[:2])]
    return [(part is not None, part) if part is not None else (False,) for part in parts]


def _match_by_code(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """``pairs`` with the stored row that each one hits as ``target``."""
    found = pairs
    for key in ["iata_code", "icao_code"]:
        hit = stored.filter(F.col(key).isNotNull()).select(key, F.struct("icao_code", "iata_code").alias(f"by_{key}"))
        found = found.join(hit, key, "left")
    target = F.coalesce("by_iata_code", "by_icao_code")
    return found.withColumn("target", target).drop("by_iata_code", "by_icao_code")
