"""SQL text twins (DuckDB dialect) of the Spark plans, for the oracle check.

Each builder appends common table expressions to a :class:`Sql` and returns
the name of the relation it defined. Populations are in long form
``(chrom_id, gene, bit)``; packing to text happens only at the end.
"""

from __future__ import annotations

from featsearch.functions.metrics import metric_sql
from featsearch.functions.rng import threshold, u32_sql
from featsearch.operators.scale import SCALE
from featsearch.operators.split import stratified_split_sql
from featsearch.sources.abt import raw_sql


class Sql:
    def __init__(self):
        self.ctes: list[tuple[str, str]] = []
        self.names: set[str] = set()

    def add(self, name: str, body: str) -> str:
        if name in self.names:
            raise ValueError(f"duplicate CTE {name}")
        self.names.add(name)
        self.ctes.append((name, body))
        return name

    def render(self, final: str) -> str:
        if not self.ctes:
            return final
        return "WITH " + ",\n".join(f"{n} AS (\n{b}\n)" for n, b in self.ctes) + "\n" + final


def abt(q: Sql, dataset: str, p: str | None = None, seed: int = 0) -> str:
    """Defines {p}_rows(row_id,y), {p}_long(raw), {p}_sp(row_id,y,split), {p}_z, {p}_q."""
    p = p or dataset
    rows, long = raw_sql(dataset)
    q.add(f"{p}_rows", rows)
    q.add(f"{p}_long", long)
    q.add(f"{p}_sp", "SELECT * FROM " + stratified_split_sql(f"{p}_rows", seed))
    q.add(f"{p}_lg", f"SELECT l.row_id, l.gene, l.x, s.y, s.split FROM {p}_long l JOIN {p}_sp s ON l.row_id = s.row_id")
    q.add(
        f"{p}_st",
        f"SELECT gene, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 OR stddev_pop(x) IS NULL THEN CAST(1 AS DOUBLE) "
        f"ELSE stddev_pop(x) END AS sd FROM {p}_lg WHERE split = 'train' GROUP BY gene",
    )
    q.add(
        f"{p}_z",
        f"SELECT l.row_id, l.y, l.split, l.gene, (l.x - s.mean) / s.sd AS z FROM {p}_lg l JOIN {p}_st s ON l.gene = s.gene",
    )
    q.add(f"{p}_q", f"SELECT row_id, y, split, gene, CAST(floor(z * {SCALE}) AS BIGINT) AS q FROM {p}_z")
    return p


def genes_of(q: Sql, p: str) -> str:
    return f"(SELECT DISTINCT gene FROM {p}_long)"


def population_init(q: Sql, name: str, p: str, n: int, seed: int = 0, generation: int = 0,
                    purpose: str = "init", first_id: int = 0, extra_key: str | None = None) -> str:
    h = u32_sql(str(seed), f"'{purpose}'", str(generation), "c.range", "g.gene")
    return q.add(
        name,
        f"SELECT CAST(c.range AS BIGINT) AS chrom_id, g.gene, CAST({h} % 2 AS INTEGER) AS bit "
        f"FROM range({first_id}, {first_id + n}) c, {genes_of(q, p)} g",
    )


def centroid_conf(q: Sql, name: str, p: str, pop: str, split: str = "val", fit_split: str = "train") -> str:
    q.add(
        f"{name}_m",
        f"SELECT gene, max(CASE WHEN y = 0 THEN m END) AS m0, max(CASE WHEN y = 1 THEN m END) AS m1 FROM "
        f"(SELECT gene, y, CAST(floor(sum(q) / count(*)) AS BIGINT) AS m FROM {p}_q WHERE split = '{fit_split}' "
        f"GROUP BY gene, y) GROUP BY gene",
    )
    q.add(
        f"{name}_c",
        f"SELECT v.row_id, v.y, v.gene, (v.q - m.m1) * (v.q - m.m1) - (v.q - m.m0) * (v.q - m.m0) AS c "
        f"FROM {p}_q v JOIN {name}_m m ON v.gene = m.gene WHERE v.split = '{split}'",
    )
    q.add(
        f"{name}_d",
        f"SELECT pp.chrom_id, c.row_id, any_value(c.y) AS y, sum(c.c) AS dec FROM {pop} pp JOIN {name}_c c "
        f"ON pp.gene = c.gene AND pp.bit = 1 GROUP BY pp.chrom_id, c.row_id",
    )
    q.add(
        f"{name}_n",
        f"SELECT CAST(sum(y) AS BIGINT) AS n1, CAST(count(*) - sum(y) AS BIGINT) AS n0 FROM {p}_sp WHERE split = '{split}'",
    )
    return q.add(
        name,
        f"""SELECT ids.chrom_id, CAST(coalesce(t.tp, 0) AS BIGINT) AS tp, CAST(coalesce(t.fp, 0) AS BIGINT) AS fp,
  CAST(n.n1 - coalesce(t.tp, 0) AS BIGINT) AS fn, CAST(n.n0 - coalesce(t.fp, 0) AS BIGINT) AS tn
FROM (SELECT DISTINCT chrom_id FROM {pop}) ids
LEFT JOIN (SELECT chrom_id, sum(CASE WHEN dec < 0 AND y = 1 THEN 1 ELSE 0 END) AS tp,
                  sum(CASE WHEN dec < 0 AND y = 0 THEN 1 ELSE 0 END) AS fp
           FROM {name}_d GROUP BY chrom_id) t ON ids.chrom_id = t.chrom_id
CROSS JOIN {name}_n n""",
    )


def scored(q: Sql, name: str, conf: str, pop: str, metric: str = "f1") -> str:
    return q.add(
        name,
        f"SELECT c.*, CASE WHEN s.nsel = 0 THEN NULL ELSE {metric_sql(metric)} END AS score "
        f"FROM {conf} c JOIN (SELECT chrom_id, sum(bit) AS nsel FROM {pop} GROUP BY chrom_id) s "
        f"ON c.chrom_id = s.chrom_id",
    )


def ranked(q: Sql, name: str, sc: str) -> str:
    return q.add(
        name,
        f"SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, chrom_id ASC) AS rank FROM {sc}",
    )


def next_generation(q: Sql, name: str, sc: str, pop: str, n: int, d, generation: int, seed: int = 0,
                    crossover: str = "onepoint", rate: float = 0.2, elitism: int = 2) -> str:
    k = n // 2
    rk = ranked(q, f"{name}_rk", sc)
    q.add(f"{name}_sv", f"SELECT r.rank, pp.gene, pp.bit FROM {rk} r JOIN {pop} pp ON r.chrom_id = pp.chrom_id WHERE r.rank <= {k}")
    m1 = u32_sql(str(seed), "'mate1'", str(generation), "t.range")
    m2 = u32_sql(str(seed), "'mate2'", str(generation), "t.range")
    q.add(f"{name}_mt", f"SELECT t.range AS slot, {m1} % {k} + 1 AS p1, {m2} % {k} + 1 AS p2 FROM range({elitism}, {k}) t")
    half = d // 2 if isinstance(d, int) else f"(({d}) // 2)"
    if crossover == "onepoint":
        pick = f"CASE WHEN a.gene < {half} THEN a.bit ELSE b.bit END"
    else:
        pick = "CASE WHEN a.gene % 2 = 0 THEN a.bit ELSE b.bit END"
    mut = u32_sql(str(seed), "'mutate'", str(generation), f"({k} + s.rank - 1)", "s.gene")
    return q.add(
        name,
        f"""SELECT CAST(rank - 1 AS BIGINT) AS chrom_id, gene, bit FROM {name}_sv WHERE rank <= {elitism}
UNION ALL
SELECT CAST(m.slot AS BIGINT) AS chrom_id, a.gene, {pick} AS bit
FROM {name}_mt m JOIN {name}_sv a ON a.rank = m.p1 JOIN {name}_sv b ON b.rank = m.p2 AND b.gene = a.gene
UNION ALL
SELECT CAST({k} + s.rank - 1 AS BIGINT) AS chrom_id, s.gene,
  CASE WHEN {mut} < {threshold(rate)} THEN 1 - s.bit ELSE s.bit END AS bit
FROM {name}_sv s""",
    )


def packed(pop: str) -> str:
    return f"(SELECT chrom_id, string_agg(CAST(bit AS VARCHAR), '' ORDER BY gene) AS genes FROM {pop} GROUP BY chrom_id)"


def n_genes(p: str) -> str:
    return f"(SELECT count(DISTINCT gene) FROM {p}_long)"


def single(q: Sql, name: str, src_pop: str, where: str) -> str:
    """One chromosome of ``src_pop`` (selected by ``where`` on its chrom_id) as chrom 0."""
    return q.add(name, f"SELECT CAST(0 AS BIGINT) AS chrom_id, gene, bit FROM {src_pop} WHERE chrom_id = ({where})")
