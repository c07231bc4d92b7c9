"""Plans: named relations in SQL that refer to each other as ``{name}``.

Spark gets each relation as a DataFrame built with ``spark.sql`` over the DataFrames it refers to, so the whole is one logical plan for
Catalyst. For checking, the same relations are put into one WITH query for DuckDB. The few functions whose names differ are macros. A relation whose
text would put a whole field in one task, or deal out what one projection can hold, has another form for Spark with the same rows (``forms``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from polyvane.plans.scratch import shared, state, write

#: Macro -> (Spark, DuckDB); {0}, {1} are its arguments.
MACROS = {
    "HASH32": ("cast(conv(substr(md5({0}), 1, 8), 16, 10) AS bigint)", "('0x' || substr(md5({0}), 1, 8))::BIGINT"),
    "HOURS": ("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', cast({0} AS timestamp_ntz)) / 3600000000.0D", "(epoch_us({0}) - epoch_us(TIMESTAMP '2024-01-01'))::DOUBLE / 3600000000.0"),
    "EVEN": ("bround({0})", "round_even({0}, 0)"),
    "BIT": ("bit_get({0}, {1})", "(({0} >> ({1})::INT) & 1)"),
    "DOUBLE": ("cast({0} AS double)", "({0})::DOUBLE"),
    "ANY": ("bool_or({0})", "bool_or({0})"),
    "LATEST": ("last_value({0}) IGNORE NULLS", "last_value({0} IGNORE NULLS)"),
    "LISTED": ("listagg({0}, ',') WITHIN GROUP (ORDER BY {1})", "string_agg({0}, ',' ORDER BY {1})"),
    # values of a group in an order; the value whose cumulated count is the first above a number; how many of its 32 low bits a number has set
    "SORTED": ("transform(array_sort(collect_list(struct({1} AS o, {0} AS v))), x -> x.v)", "list({0} ORDER BY {1})"),
    # Spark sorts the number in among the counts, one more as they are whole: a lambda would keep all it holds, the draw's hash included, out of generated code
    "PICK": ("element_at({0}, cast(array_position(sort_array(concat({1}, array({2} + 1))), {2} + 1) AS int))", "({0})[1 + len(list_filter({1}, lambda h: h <= {2}))]"),
    "GSUB": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "ONES": ("bit_count({0})", "bit_count(({0})::BIGINT)::INT"),
    # the members of an array that the bits of a number name
    "SUBSET": ("array_join(filter({0}, (bit_, at_) -> bit_get({1}, at_) = 1), '|')", "array_to_string(list_filter({0}, lambda bit_, at_: (({1} >> (at_ - 1)::INT) & 1) = 1), '|')"),
    # rows of a relation once for each number below a column of it
    "UPTO": ("(SELECT {0}, explode(sequence(0, {1} - 1)) AS i FROM {2})", "(SELECT {0}, unnest(range(0, {1}))::INT AS i FROM {2})"),
    "BITS": ("(SELECT {0}, posexplode(split({1}, '[|]')) AS (pos, bit) FROM {2})", "(SELECT {0}, unnest(string_split({1}, '|')) AS bit, generate_subscripts(string_split({1}, '|'), 1) - 1 AS pos FROM {2})"),
}


def arguments(sql: str, at: int) -> tuple[list[str], int]:
    """Arguments of the call whose '(' is at ``at``, and the place after it."""
    depth, start, out, quoted = 0, at + 1, [], False
    for k in range(at, len(sql)):
        c = sql[k]
        if c == "'":
            quoted = not quoted
        if quoted:
            continue
        depth += (c == "(") - (c == ")")
        if depth == 1 and c == ";" or depth == 0:
            out.append(sql[start:k].strip())
            start = k + 1
            if depth == 0:
                return out, k + 1
    raise ValueError("unbalanced macro call")


def expand(sql: str, duck: bool) -> str:
    """Expand @NAME(a; b) macros, innermost last."""
    while m := re.search(r"@([A-Z0-9]+)\(", sql):
        args, end = arguments(sql, m.end() - 1)
        form = MACROS[m[1]][duck]
        for k, a in enumerate(args):
            form = form.replace(f"{{{k}}}", a)
        sql = sql[:m.start()] + form + sql[end:]
    if not duck:  # fractions are doubles in both engines, not decimals
        parts = sql.split("'")
        sql = "'".join(x if k % 2 else re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1D", x) for k, x in enumerate(parts))
    return sql


class Plan:
    #: Relations that several others read: written once instead of computed again by each. That also keeps plans small.
    KEEP = ("notes", "raw_slices", "steps", "beats", "phrases", "moves", "held", "numbered", "residuals", "cells_real", "cells_null", "pitch_cat", "dp_cat",
            "discover_full", "discover_hard", "hits", "testable", "calibration_hard", "bits", "bit_lists",
            "uniform_residuals", "independent_residuals", "u_testable", "i_testable", "u_hits", "i_hits", "method_auc", "paired",
            "ladder_units", "ladder_wide", "ladder_cells", "random_cuts", "placed", "draw_cats", "draw_guides", "replay_cells", "sim_cells", "replay_residuals", "sim_z", "piece_counts", "k_piece_counts", "vocabulary_coarse", "lattice_cells", "lattice", "supported", "signatures", "r_hits", "r_testable")
    #: Those by piece from which draws and cells are made, many rows from each: dealt by piece to all tasks, which adaptive execution would merge to few.
    SPREAD = ("notes", "raw_slices", "steps", "beats", "moves", "held", "numbered", "ladder_wide")
    #: In a form, as many tasks as few rows are dealt to from which many are made: the cluster's cores, and more with the input, by a megabyte each.
    TASKS, MOST_TASKS = "#TASKS", 2000
    #: Prefixes of the same relations over another corpus or part of it.
    PREFIX = re.compile(r"^([txh]\d?_)+")

    def __init__(self):
        self.nodes: dict[str, str] = {}
        self.forms: dict[str, str] = {}

    def add(self, **nodes: str) -> Plan:
        self.nodes.update(nodes)
        for name in nodes:  # a form is of the text that it was given for
            self.forms.pop(name, None)
        return self

    def add_forms(self, **forms: str) -> Plan:
        """What Spark runs for relations instead of their text; the rows are the same."""
        self.forms.update(forms)
        return self

    def form(self, name: str) -> str:
        return self.forms.get(name) or self.nodes[name]

    def renamed(self, prefix: str) -> Plan:
        """The same relations under names that begin with prefix, over the same tables."""
        def swap(sql: str) -> str:
            return re.sub(r"\{(\w+)\}", lambda m: f"{{{prefix}{m[1]}}}" if m[1] in self.nodes or m[1] in self.forms else m[0], sql)

        return Plan().add(**{f"{prefix}{k}": swap(v) for k, v in self.nodes.items()}).add_forms(**{f"{prefix}{k}": swap(v) for k, v in self.forms.items()})

    @staticmethod
    def inputs(sql: str) -> list[str]:
        return list(dict.fromkeys(re.findall(r"\{(\w+)\}", re.sub(r"\{\d+\}", "", sql))))

    def frame(self, name: str, tables: dict[str, DataFrame], spark: SparkSession, made: dict[str, DataFrame] | None = None) -> DataFrame:
        made = {} if made is None else made
        if name in tables:
            return tables[name]
        if name not in made:
            sql = expand(self.form(name), False)
            if self.TASKS in sql:
                sql = sql.replace(self.TASKS, str(self.tasks(spark, tables, made)))
            build = lambda: spark.sql(sql, **{x: self.frame(x, tables, spark, made) for x in self.inputs(sql)})
            if self.PREFIX.sub("", name) in self.KEEP:
                key = (name, self.text(name), self.inputs_now(spark, tables, made))
                spread = self.PREFIX.sub("", name) in self.SPREAD
                made[name] = shared(spark, key, lambda: write(spark, build().repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "piece") if spread else build(), name))
            else:
                made[name] = build()
        return made[name]

    @staticmethod
    def inputs_now(spark: SparkSession, tables: dict[str, DataFrame], made: dict) -> tuple:
        if "" not in made:  # once a query
            made[""] = (*(f.semanticHash() for _, f in sorted(tables.items())), state(spark, tables))
        return made[""]

    def tasks(self, spark: SparkSession, tables: dict[str, DataFrame], made: dict) -> int:
        size = sum(length for _, length, _ in self.inputs_now(spark, tables, made)[-1])
        return min(self.MOST_TASKS, max(spark.sparkContext.defaultParallelism, size >> 20))

    def text(self, name: str) -> str:
        """The relation's SQL with that of all it reads."""
        seen: dict[str, str] = {}

        def visit(x: str) -> None:
            if (x in self.nodes or x in self.forms) and x not in seen:
                seen[x] = self.form(x)
                for y in self.inputs(seen[x]):
                    visit(y)

        visit(name)
        return "\n".join(f"{k}: {v}" for k, v in sorted(seen.items()))

    def duck(self, name: str) -> str:
        order: list[str] = []

        def visit(x: str) -> None:
            if x in self.nodes and x not in order:
                for y in self.inputs(self.nodes[x]):
                    visit(y)
                order.append(x)

        visit(name)
        parts = [f"{x} AS MATERIALIZED ({re.sub(r'\{(\w+)\}', r'\1', expand(self.nodes[x], True))})" for x in order]
        return f"WITH {', '.join(parts)} SELECT * FROM {name}"
