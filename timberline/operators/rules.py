"""Rules on log rows, compiled to columns and evaluated in one projection."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIORITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
TYPES = ("KEYWORD", "LEVEL", "SOURCE", "THRESHOLD", "TIME_WINDOW", "SEQUENCE", "PATTERN", "COMPOSITE", "CUSTOM")


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    type: str = "KEYWORD"
    condition: str = ""
    severity: float = 0.8
    priority: str = "MEDIUM"
    enabled: bool = True
    frequency: int = 5
    seconds: int = 60
    adaptive: bool = False
    multiplier: float = 1.5
    most_tracked: int = 1000


DEFAULT_RULES = (Rule("error_keyword", "Error keyword", "KEYWORD", "ERROR", 0.9, "HIGH"), Rule("critical_keyword", "Critical keyword", "KEYWORD", "CRITICAL", 1.0, "CRITICAL"))


class RuleSet:
    """Rules by id. plugins: name -> function(rule) that gives a boolean column; a CUSTOM rule holds if any does."""

    def __init__(self, rules: Iterable[Rule] = DEFAULT_RULES, adaptive: bool = False):
        self.rules = {r.id: r for r in rules}
        self.adaptive = adaptive
        self.plugins: dict[str, Callable[[Rule], Column]] = {}

    def add(self, rule: Rule) -> bool:
        if not rule.id or rule.id in self.rules:
            return False
        self.rules[rule.id] = rule
        return True

    def remove(self, rule_id: str) -> bool:
        return self.rules.pop(rule_id, None) is not None

    def update(self, rule_id: str, rule: Rule) -> bool:
        if rule_id not in self.rules:
            return False
        self.rules[rule_id] = replace(rule, id=rule_id)
        return True

    def get(self, rule_id: str) -> Rule | None:
        return self.rules.get(rule_id)

    def reload(self, settings: dict[str, str]) -> int:
        """Only the rules of these settings (see load) from now on; how many."""
        return self.load(settings, merge=False)

    def enable(self, rule_id: str, on: bool = True) -> bool:
        return rule_id in self.rules and self.update(rule_id, replace(self.rules[rule_id], enabled=on))

    def register(self, name: str, plugin: Callable[[Rule], Column]) -> None:
        self.plugins[name] = plugin

    def unregister(self, name: str) -> None:
        self.plugins.pop(name, None)

    def ordered(self) -> list[Rule]:
        return sorted((r for r in self.rules.values() if r.enabled), key=lambda r: PRIORITIES.index(r.priority))

    def load(self, settings: dict[str, str], merge: bool = True) -> int:
        """rule.<id> = name TYPE condition...; rule.<id>.enabled and rule.<id>.severity set those. How many were read."""
        if not merge:
            self.rules.clear()
        read = 0
        for key, value in settings.items():
            parts = key.split(".")
            if parts[0] != "rule" or len(parts) != 2 or not parts[1]:
                continue
            words = value.split()
            if len(words) < 2:
                continue
            kind = words[1].upper() if words[1].upper() in TYPES else "KEYWORD"
            severity = settings.get(f"{key}.severity")
            try:
                severity = min(1.0, max(0.0, float(severity))) if severity is not None else 0.8
            except ValueError:
                severity = 0.8
            on = settings.get(f"{key}.enabled", "true").lower() not in ("false", "0", "no", "off")
            self.rules[parts[1]] = Rule(parts[1], words[0], kind, " ".join(words[2:]), severity, enabled=on)
            read += 1
        return read

    def compiled(self, rule: Rule) -> Column:
        if rule.type == "KEYWORD":
            return F.contains(F.upper("message"), F.lit(rule.condition.upper()))
        if rule.type == "LEVEL":
            return F.col("level") == int(rule.condition) if rule.condition.strip().isdigit() else F.lit(False)
        if rule.type == "SOURCE":
            return (F.col("source") != "") & (F.lower("source") == rule.condition.lower())
        if rule.type == "THRESHOLD":
            # events up to this one within the rule's seconds; the frame is for each hour and the one before
            limit = rule.frequency * (rule.multiplier if self.adaptive and rule.adaptive else 1.0)
            return F.least(F.col(f"_seen_{rule.seconds}"), F.lit(rule.most_tracked)) >= limit
        if rule.type == "CUSTOM":
            out = F.lit(False)
            for plugin in self.plugins.values():
                out = out | plugin(rule)
            return out
        return F.lit(False)

    def matches(self, entries: DataFrame) -> DataFrame:
        """seq, rule_id, rule_name, score, priority of every rule that holds, in the order of priorities."""
        rules, rows = self.ordered(), entries
        for seconds in {r.seconds for r in rules if r.type == "THRESHOLD"}:
            rows = with_event_counts(rows, seconds, f"_seen_{seconds}")
        hit = lambda k, r: F.when(F.coalesce(self.compiled(r), F.lit(False)), F.struct(F.lit(k).alias("rank"), F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(float(r.severity)).alias("score"), F.lit(r.priority).alias("priority")))
        if not rules:
            return entries.select("seq", F.lit(0).alias("rank"), F.lit("").alias("rule_id"), F.lit("").alias("rule_name"), F.lit(0.0).alias("score"), F.lit("").alias("priority")).limit(0)
        hits = F.filter(F.array(*(hit(k, r) for k, r in enumerate(rules))), lambda x: x.isNotNull())
        return rows.select("seq", F.explode(hits).alias("m")).select("seq", "m.*")

    def statistics(self, entries: DataFrame) -> DataFrame:
        return self.matches(entries).groupBy("rule_id").agg(F.count("*").alias("matches"))

    def totals(self, entries: DataFrame) -> DataFrame:
        """One row: rules that are on, entries checked, evaluations (each rule on each entry), matches, entries with one."""
        on = len(self.ordered())
        found = self.matches(entries).agg(F.count("*").alias("matches"), F.count_distinct("seq").alias("matched_entries"))
        checked = entries.agg(F.count("*").alias("checked"))
        return checked.crossJoin(found).select(F.lit(on).alias("rules"), "checked", (F.col("checked") * on).alias("evaluations"), "matches", "matched_entries")


def with_event_counts(rows: DataFrame, seconds: int, name: str) -> DataFrame:
    """rows with how many events, this one included, came in the last seconds; later ones of the same second do not
    count. Slices of time at least that long are handled with the slice before them, so no task sees all rows."""
    width = max(seconds + 1, 3600)
    counts = rows.groupBy("ts_sec").agg(F.count("*").alias("n")).withColumn("slice", F.floor(F.col("ts_sec") / width))
    both = counts.withColumn("own", F.lit(True)).unionByName(counts.withColumns({"slice": F.col("slice") + 1, "own": F.lit(False)}))
    older = F.coalesce(F.sum("n").over(Window.partitionBy("slice").orderBy("ts_sec").rangeBetween(-seconds, -1)), F.lit(0))
    seen = both.withColumn("older", older).filter("own").select("ts_sec", "older")
    own = F.row_number().over(Window.partitionBy("ts_sec").orderBy("seq"))
    return rows.withColumn("_own", own).join(seen, "ts_sec").withColumn(name, F.col("_own") + F.col("older")).drop("_own", "older")
