"""The two SQL spellings in use: Spark for running, DuckDB for checking."""

from __future__ import annotations


class SparkDialect:
    name = "spark"

    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    def digest(self, seed, *parts) -> str:
        fields = ", ".join(f"coalesce(cast({p} AS string), '')" for p in parts)
        return f"sha2(concat_ws('|', '{seed}', {fields}), 256)"

    def number(self, hex_expr: str) -> str:
        return f"cast(conv({hex_expr}, 16, 10) AS bigint)"

    def day(self, expr: str) -> str:
        return f"date_format({expr}, 'yyyy-MM-dd')"

    def fold(self, array: str, n: int) -> str:
        """The whole array in ``n`` sums: entry i adds up every n-th element from i on."""
        return f"transform(sequence(0, {n - 1}), i -> aggregate(filter({array}, (x, j) -> j % {n} = i), 0D, (a, x) -> a + double(x)))"


class DuckDialect(SparkDialect):
    name = "duckdb"

    def __init__(self):
        super().__init__("")

    def table(self, name: str) -> str:
        return name

    def digest(self, seed, *parts) -> str:
        fields = ", ".join(f"coalesce(cast({p} AS varchar), '')" for p in parts)
        return f"sha256(concat_ws('|', '{seed}', {fields}))"

    def number(self, hex_expr: str) -> str:
        return f"cast(('0x' || {hex_expr}) AS bigint)"

    def day(self, expr: str) -> str:
        return f"strftime({expr}, '%Y-%m-%d')"

    def fold(self, array: str, n: int) -> str:
        return f"list_transform(range({n}), lambda i: list_sum(list_filter({array}::DOUBLE[], lambda x, j: (j - 1) % {n} = i)))"


DUCK = DuckDialect()


def h16(seed, *parts, d: SparkDialect = DUCK) -> str:
    """SQL of ``functions.hashing.stable_hash``."""
    return f"substr({d.digest(seed, *parts)}, 1, 16)"


def unit(seed, *parts, d: SparkDialect = DUCK) -> str:
    """SQL of ``functions.hashing.hash_uniform``."""
    head = f"substr({d.digest(seed, *parts)}, 1, 13)"
    return f"((cast({d.number(head)} AS double) + 0.5) / 4503599627370496.0)"
