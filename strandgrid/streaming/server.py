"""Search requests as JSON, answered in batches or from a stream.

A request has a type (search, handshake, shutdown); a search has a query_type (single, file), a search_mode (full, coarse), a query,
an outer_radius, an inner_radius, an inner_metric and max_filter_misses, all but the query optional. Where radii are missing the
parameter tables give them. Requests of a batch are searched together in one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import params, search

REQUEST = "id string, type string, query_type string, search_mode string, query string, outer_radius double, inner_radius double, inner_metric string, max_filter_misses int"
COARSE, INNER, METRIC = 0.3, 0.2, "needle"


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Requests of JSON lines, defaults filled in; a line that isn't JSON becomes a request of no type."""
    rows = lines.select(F.from_json(column, REQUEST).alias("r")).select("r.*")
    return rows.withColumns({
        "type": F.coalesce("type", F.lit("search")), "search_mode": F.coalesce("search_mode", F.lit("full")), "query_type": F.coalesce("query_type", F.lit("single")),
        "inner_radius": F.coalesce("inner_radius", F.lit(INNER)), "inner_metric": F.coalesce("inner_metric", F.lit(METRIC)),
    })


def answer(requests: DataFrame, covered: DataFrame, vector: Callable[[DataFrame, str], DataFrame], side: float, d: int, k: int, dims: int = 2) -> DataFrame:
    """(id, query, hit, dist) of the searches among parsed requests; a handshake is answered by a row without a hit.

    covered: the index (kmer, v, cell); vector adds the column v for a column of k-mers. Coarse requests return all
    members of the cells found. Requests that share their radii and metric are one search; there are as many plans as such settings, none left out.
    """
    greeted = requests.where("type = 'handshake'").select("id", F.col("type").alias("query"), F.lit(None).cast("string").alias("hit"), F.lit(None).cast("double").alias("dist"))
    asked = requests.where("type = 'search' AND query IS NOT NULL")
    default = params.coarse_radius("inner_radius", *next(iter(params.COARSE_RADIUS))) if (d, k) in params.COARSE_RADIUS else F.lit(COARSE)
    asked = asked.withColumn("outer_radius", F.coalesce("outer_radius", default))
    settings = asked.select("search_mode", "outer_radius", "inner_radius", "inner_metric", "max_filter_misses").distinct().collect()
    out = greeted
    for s in settings:
        own = asked.where(" AND ".join(f"{c} <=> {_literal(s[c])}" for c in ("search_mode", "outer_radius", "inner_radius", "inner_metric", "max_filter_misses"))).select("id", "query")
        q = vector(own.select("query").distinct(), "query")
        metric = "none" if s["search_mode"] == "coarse" else s["inner_metric"]
        misses = k if metric == "none" else s["max_filter_misses"] if s["max_filter_misses"] is not None else ceil(s["inner_radius"] * k)
        found = search.kmer_search(q, covered, s["outer_radius"], side, d, s["inner_radius"], misses, metric, k=k, dims=dims)
        out = out.unionByName(own.join(found, "query").select("id", "query", "hit", "dist"))
    return out


def _literal(x) -> str:
    return "NULL" if x is None else f"{x!r}D" if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def serve(lines: DataFrame, covered: DataFrame, vector, side: float, d: int, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, **how):
    """A streaming query over a stream of request lines: each micro-batch is answered and given to sink(answers, batch number).

    A shutdown request ends nothing here: stop the returned query instead.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            sink(answer(parse(rows), covered, vector, side, d, k, **how), number)
        finally:
            rows.unpersist()

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
