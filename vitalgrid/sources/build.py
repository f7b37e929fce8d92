"""Building products only where their code or an input has changed.

Every product has a digest over its code version and the digests of what it reads: tables, and other
products by their own digests. A change anywhere reaches the products built from it and no others, and it
is known before anything is computed. Products are listed in code, so their digests are made on the
driver; tables are known by their files, no row of them is read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = (
    "product string, state string, code string, inputs string, digest string, sources array<string>, "
    "decimals int, rows long, path string"
)


@dataclass(frozen=True)
class Product:
    """A table made from the named tables and products by ``make``; ``code`` names its version."""

    name: str
    code: str
    reads: tuple[str, ...]
    make: Callable[[Mapping[str, DataFrame]], DataFrame]
    decimals: int | None = None


def _sha(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


def files_digest(table: DataFrame) -> DataFrame:
    """(files, digest) of a table read from files: from their names, sizes and times of change, which need
    no column of any row. A combination of hashes that does not depend on order."""
    file = table.select("_metadata.file_name", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    h = F.xxhash64("file_name", "file_size", "file_modification_time")
    total = F.sum(h.cast("decimal(20,0)"))
    digest = F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.bit_xor(h).cast("string"), total.cast("string")), 256)
    return file.agg(F.count("*").alias("files"), digest.alias("digest"))


def digests(products: Sequence[Product], tables: Mapping[str, str]) -> dict[str, tuple[str, str]]:
    """Digest of inputs and digest of each product, from the digests of the tables. A product that reads
    what is neither a table nor a product, or that needs itself, is an error."""
    by_name = {p.name: p for p in products}
    if len(by_name) < len(products) or by_name.keys() & tables.keys():
        raise ValueError("each product and table has a name of its own")
    found: dict[str, tuple[str, str]] = {}
    for name in TopologicalSorter({p.name: [r for r in p.reads if r in by_name] for p in products}).static_order():
        one = by_name[name]
        lost = [r for r in one.reads if r not in found and r not in tables]
        if lost:
            raise ValueError(f"{name} reads {', '.join(lost)}, which nothing provides")
        inputs = _sha(sorted((r, found[r][1] if r in found else tables[r]) for r in one.reads))
        found[name] = inputs, _sha(name, one.code, one.decimals, inputs)
    return found


def _state(one: Product, inputs: str, old: Mapping[str, object] | None) -> str:
    if old is None:
        return "added"
    if old["code"] != one.code or old["decimals"] != one.decimals:
        return "changed code"
    return "unchanged" if old["inputs"] == inputs else "changed input"


def build(
    spark: SparkSession,
    products: Sequence[Product],
    tables: Mapping[str, DataFrame],
    table_digests: Mapping[str, str],
    path: str,
    old: DataFrame | None = None,
) -> DataFrame:
    """Write the products that are new or whose code or inputs changed since the manifest ``old``, and return
    the new manifest, with a row `removed` for products that are no longer listed.

    An unchanged product is not made: it keeps its files, and products that read it read those. Each
    product has a folder of its own for each digest, so files in use are never overwritten. Where making a
    product fails, the manifest of those before it is written before the error is raised, and the next
    build goes on from there; the manifest is kept in the folder, too.
    """
    # one row a product
    known = {r["product"]: r.asDict() for r in old.where("state <> 'removed'").collect()} if old is not None else {}
    by_name = {p.name: p for p in products}
    rows: list[tuple] = []
    made: dict[str, DataFrame] = {}
    every = digests(products, table_digests)
    try:
        for name, (inputs, digest) in every.items():
            one, before = by_name[name], known.get(name)
            state = _state(one, inputs, before)
            if state == "unchanged":
                place, count = before["path"], before["rows"]
            else:
                place = f"{path}/{name}-{digest[:16]}"
                out = one.make({r: made[r] if r in made else tables[r] for r in one.reads})
                out.write.mode("overwrite").parquet(place)  # what a failed build left goes
                count = spark.read.parquet(place).count()
            made[name] = spark.read.parquet(place)
            rows.append((name, state, one.code, inputs, digest, list(one.reads), one.decimals, count, place))
    finally:
        done = {r[0] for r in rows}
        if len(done) == len(every):
            gone = [known[n] for n in known if n not in by_name]
            rows += [(g["product"], "removed", g["code"], g["inputs"], g["digest"], g["sources"], g["decimals"], None, g["path"]) for g in gone]
        else:  # products not reached keep their entries
            rows += [tuple({**known[n], "state": "unchanged"}.values()) for n in every if n in known and n not in done]
        out_path = f"{path}/manifest-{_sha(rows)[:16]}"
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(out_path)
    return spark.read.schema(MANIFEST).parquet(out_path)
