"""Ordered keyword rules over a text column.

Rules are data: a list of (label, any-of keywords, none-of keywords). The
first rule whose keywords hit wins; matching is case-insensitive substring
search. The whole rule list compiles to one ``CASE WHEN`` chain, evaluated
JVM-side per row, so the text column is never shipped to Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    label: str
    any_of: tuple[str, ...]
    none_of: tuple[str, ...] = ()

    def needed_keywords(self) -> list[str]:
        """``any_of`` without keywords that contain another keyword of the
        rule: wherever the longer one occurs the shorter one does too, so
        leaving it out changes no label and saves a scan of the text."""
        words = list(dict.fromkeys(k.lower() for k in self.any_of))
        return [w for w in words if not any(o != w and o in w for o in words)]

    def condition(self, lowered: Column) -> Column:
        hit = None
        for k in self.needed_keywords():
            c = lowered.contains(k.lower())
            hit = c if hit is None else (hit | c)
        for k in self.none_of:
            hit = hit & ~lowered.contains(k.lower())
        return hit


def rule(label: str, any_of: Iterable[str], none_of: Iterable[str] = ()) -> Rule:
    return Rule(label, tuple(any_of), tuple(none_of))


# Default request rules, in priority order (fixed values).
DEFAULT_RULES: tuple[Rule, ...] = (
    rule("RUN_AIRFLOW_SCHEDULE", ["schedule", "scheduled", "cron"]),
    rule("RUN_AIRFLOW", ["airflow", "run on", "trigger"]),
    rule("MYSQL_TO_HDFS", ["push sql to hdfs", "mysql to hdfs", "sql to hdfs"]),
    rule("PUSH_MYSQL", ["push to mysql", "push to sql", "store in mysql", "save to mysql", "store in sql"]),
    rule("STORE_HDFS_ICEBERG", ["iceberg", "icebeg", "icberg", "isberg", "icebrg", "icebr", "icebe", "ice berg"]),
    rule("STORE_HDFS", ["store", "push", "save", "upload", "hdfs"]),
    rule("REMOVE_NULLS:drop", ["clean null", "remove null", "drop null"]),
    rule("REMOVE_NULLS:fill", ["fill null"]),
    rule("REMOVE_DUPLICATES", ["duplicate"]),
    rule("FIND_NULLS", ["find null"]),
    rule("DETECT_SCHEMA", ["schema"]),
    rule("GENERATE_PYSPARK", ["pyspark"]),
    rule("BUILD_PIPELINE", ["pipeline"]),
    rule("GENERATE_SQL", ["sql"], none_of=["mysql"]),
    rule("LOAD_MYSQL", ["mysql", "load mysql", "from mysql"]),
)
DEFAULT_LABEL = "UNKNOWN"


def classify(text: Column | str, rules: Sequence[Rule] = DEFAULT_RULES,
             default: str | None = DEFAULT_LABEL) -> Column:
    """The label of the first rule that matches ``text`` (else ``default``).

    A null text gets ``default`` too, as an empty message would.
    """
    lowered = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    out = None
    for r in rules:
        if not r.any_of:
            raise ValueError(f"rule {r.label!r} has no keywords")
        out = F.when(r.condition(lowered), F.lit(r.label)) if out is None else out.when(
            r.condition(lowered), F.lit(r.label))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default))


def rules_sql(text_sql: str, rules: Sequence[Rule] = DEFAULT_RULES, default: str = DEFAULT_LABEL) -> str:
    """The same rule list as an ANSI ``CASE`` expression (for other engines)."""
    lowered = f"LOWER(COALESCE({text_sql}, ''))"

    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    arms = []
    for r in rules:
        hit = " OR ".join(f"CONTAINS({lowered}, {lit(k.lower())})" for k in r.any_of)
        miss = "".join(f" AND NOT CONTAINS({lowered}, {lit(k.lower())})" for k in r.none_of)
        arms.append(f"WHEN ({hit}){miss} THEN {lit(r.label)}")
    return "CASE " + " ".join(arms) + f" ELSE {lit(default)} END"
