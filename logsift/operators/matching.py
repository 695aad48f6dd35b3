"""Keyword and behaviour matches against a technique library."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions.automaton import Automaton, spans
from logsift.functions.text import clip, text
from logsift.operators.rules import Role, Rule, condition, rule_evidence, suppress
from logsift.spec import ColumnMeta

EVIDENCE_ROLES = ("command_line", "process_name", "file_name", "host", "text_evidence")


@dataclass(frozen=True)
class Library:
    techniques: tuple[dict, ...]
    rules: tuple[dict, ...]
    problems: tuple[str, ...] = ()


def _check(found: dict) -> None:
    def need(ok, what):
        if not ok:
            raise ValueError(what)

    need(found.get("schemaVersion") == 1, "unknown schemaVersion")
    need(str(found.get("libraryId", "")).strip(), "no libraryId")
    need(found.get("techniques"), "no techniques")
    for t in found["techniques"]:
        need(str(t.get("techniqueId", "")).strip() and str(t.get("name", "")).strip(), "a technique without id or name")
        need(t.get("tactics") and all(x.get("id", "").strip() and x.get("name", "").strip() for x in t["tactics"]), f"{t['techniqueId']}: no tactics")
        need(t.get("keywords"), f"{t['techniqueId']}: no keywords")
        for k in t["keywords"]:
            need(k.get("id", "").strip() and k.get("pattern", "").strip(), f"{t['techniqueId']}: a keyword without id or pattern")
            need(0 <= k.get("score", -1) <= 100, f"{k['id']}: a score outside 0 to 100")
    seen = set()
    known = {t["techniqueId"] for t in found["techniques"]}
    for r in found.get("behaviorRules", []):
        need(r["id"] not in seen, f"{r['id']}: a rule id used twice")
        need(r["techniqueId"] in known, f"{r['id']}: an unknown technique")
        seen.add(r["id"])
        Rule(r["id"], r["name"], tuple(condition(c) for c in r["conditions"]))


def load_library(*paths: str) -> Library:
    """The built-in library and further files; a file that isn't valid is left out with a message."""
    techniques, rules, problems = [], [], []
    for path in (Path(__file__).parent.parent / "resources" / "techniques.json", *map(Path, paths)):
        try:
            found = json.loads(path.read_text())
            _check(found)
        except (ValueError, KeyError, TypeError, OSError) as e:
            problems.append(f"{path.name}: {e}")
            continue
        techniques += found["techniques"]
        rules += found.get("behaviorRules", [])
    return Library(tuple(techniques), tuple(rules), tuple(problems))


def library_tables(spark: SparkSession, library: Library) -> dict[str, DataFrame]:
    """patterns, tactics, terms and rules as tables."""
    patterns = [(t["techniqueId"], t["name"], k["id"], k["pattern"], k.get("match", "substring"), k["score"]) for t in library.techniques for k in t["keywords"]]
    tactics = [(t["techniqueId"], x["id"], x["name"]) for t in library.techniques for x in t["tactics"]]
    rules = [(r["id"], r["name"], r["techniqueId"], r["score"], len(r["conditions"])) for r in library.rules]
    make = spark.createDataFrame
    return {
        "patterns": make(patterns, "technique_id string, technique_name string, keyword_id string, pattern string, match string, score int"),
        "tactics": make(tactics, "technique_id string, tactic_id string, tactic_name string"),
        "terms": make(_terms(library), "technique_id string, term string"),
        "rules": make(rules, "rule_id string, rule_name string, technique_id string, score int, conditions int"),
    }


def _fold(value: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in value)


def any_of(words: list[str]) -> str:
    """A pattern that finds any of some texts. It is a tree by first characters, so that few branches are tried at a place."""
    if "" in words:
        return ""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[0], []).append(w[1:])
    parts = [(c if c.isalnum() or c in ' "<>/\'' else re.escape(c)) + any_of(sorted(set(rest))) for c, rest in sorted(by_first.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


_MATCH = "tactic_id string, tactic_name string, technique_id string, technique_name string, keyword string, column_name string, score int, source string"


def match_keywords(df: DataFrame, library: Library, evidence: list[str]) -> DataFrame:
    """row_num, tactic, technique, keyword, column, score: one row for each (cell, pattern, tactic).

    One automaton of all patterns reads the cells of an Arrow batch side by side, a byte at a time (``Automaton``), so
    the number of patterns doesn't matter; of a pattern the first place in a cell counts, and that of a whole word must
    touch no letter or digit. A scan: nothing is shuffled. The automaton goes to each machine once; it is as large as the
    library.
    """
    keywords = [(t, k) for t in library.techniques for k in t["keywords"]]
    whole = np.array([k.get("match") == "word" or (k["pattern"].isalnum() and len(k["pattern"]) <= 3) for _, k in keywords], bool)
    # a line of the library for each tactic of a pattern
    told = [(x["id"], x["name"], t["techniqueId"], t["name"], k["pattern"], k["score"]) for t, k in keywords for x in t["tactics"]]
    n = np.array([len(t["tactics"]) for t, _ in keywords], np.int64)
    types = [pa.string()] * 5 + [pa.int32()]
    shared = df.sparkSession.sparkContext.broadcast((Automaton([k["pattern"] for _, k in keywords]), whole, n, np.cumsum(n) - n, [pa.array(c, t) for c, t in zip(zip(*told), types)]))
    names = list(evidence)

    def scan(batches):
        automaton, whole, n, first, lines = shared.value
        for batch in batches:
            for i, name in enumerate(names):
                data, at = spans(batch.column(i + 1))
                cell, pattern, place = automaton.scan(data, at)
                k = ~whole[pattern]
                k[~k] = automaton.alone(data, at, cell[~k], pattern[~k], place[~k])
                cell, pattern = cell[k], pattern[k]
                if not len(cell):
                    continue
                size = n[pattern]
                line = pa.array(np.repeat(first[pattern] - (np.cumsum(size) - size), size) + np.arange(int(size.sum())))
                row = batch.column(0).take(pa.array(np.repeat(cell, size)))
                told = [c.take(line) for c in lines]
                yield pa.RecordBatch.from_arrays([row, *told[:5], pa.array([name] * len(row), pa.string()), told[5], pa.array(["keyword"] * len(row), pa.string())], names=["row_num", *[c.split()[0] for c in _MATCH.split(", ")]])

    rows = df.select("row_num", *[text(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)])
    return rows.mapInArrow(scan, f"row_num {dict(df.dtypes)['row_num']}, {_MATCH}")


def match_rules(df: DataFrame, library: Library, meta: list[ColumnMeta], roles: dict[str, Role]) -> DataFrame | None:
    """Behaviour rules whose conditions all hold on a row; suggested and confirmed roles count. None if none can be tested."""
    by_id = {t["techniqueId"]: t for t in library.techniques}
    told = []
    for r in library.rules:
        rule = Rule(r["id"], r["name"], tuple(condition(c) for c in r["conditions"]))
        if (e := rule_evidence(rule, meta, roles, ("suggested", "confirmed"))) is None:
            continue
        t = by_id[r["techniqueId"]]
        tactics = F.array(*[F.struct(F.lit(x["id"]).alias("id"), F.lit(x["name"]).alias("name")) for x in t["tactics"]])
        told.append(F.when(e.isNotNull(), F.struct(F.lit(t["techniqueId"]).alias("technique_id"), F.lit(t["name"]).alias("technique_name"), clip(e["value"], 48).alias("keyword"), e["column"].alias("column_name"), F.lit(int(r["score"])).alias("score"), tactics.alias("tactics"))))
    if not told:
        return None
    hits = df.select("row_num", F.explode(F.array_compact(F.array(*told))).alias("h")).select("row_num", "h.*", F.explode("h.tactics").alias("t"))
    return hits.select("row_num", F.col("t.id").alias("tactic_id"), F.col("t.name").alias("tactic_name"), "technique_id", "technique_name", "keyword", "column_name", "score", F.lit("rule").alias("source"))


def scan(df: DataFrame, library: Library, meta: list[ColumnMeta], roles: dict[str, Role], ignored: DataFrame | None = None) -> DataFrame:
    """All matches of rows that aren't ignored."""
    rows = suppress(df, ignored)
    evidence = [roles[r].column for r in EVIDENCE_ROLES if r in roles and roles[r].status in ("suggested", "confirmed")]
    found = match_keywords(rows, library, evidence) if evidence else None
    rules = match_rules(rows, library, meta, roles)
    if found is None and rules is None:
        raise ValueError("no evidence column and no rule to test")
    return rules if found is None else found if rules is None else found.unionByName(rules)


def technique_counts(matches: DataFrame) -> DataFrame:
    """Hits (each once, whatever its tactics) and rows of each technique."""
    hits = matches.select("row_num", "technique_id", "technique_name", "keyword", "column_name", "source").distinct()
    return hits.groupBy("technique_id", "technique_name").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("row_num").alias("rows")).orderBy(F.desc("matches"), "technique_id")


def tactic_counts(matches: DataFrame) -> DataFrame:
    """(hit, tactic) pairs and rows of each tactic."""
    return matches.groupBy("tactic_id", "tactic_name").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("row_num").alias("rows")).orderBy(F.desc("matches"), "tactic_id")


def scan_summary(df: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: rows in the table, matches, rows with a match."""
    return df.agg(F.count(F.lit(1)).alias("rows_scanned")).join(F.broadcast(matches.agg(F.count(F.lit(1)).alias("match_count"), F.count_distinct("row_num").alias("matched_rows"))))


def _phrase(value: str) -> str:
    return " ".join(w for w in re.split(r"[^0-9a-z]+", value.lower()) if w)


def _terms(library: Library) -> list[tuple[str, str]]:
    """What a technique can be called by: its id, name, either side of a colon, aliases, keywords and tactics."""
    found = set()
    for t in library.techniques:
        names = [t["techniqueId"], t["name"], *t["name"].split(":"), *t.get("aliases", []), *(k["pattern"] for k in t["keywords"]), *(x["name"] for x in t["tactics"])]
        found |= {(t["techniqueId"], p) for n in names if (p := _phrase(n))}
    return sorted(found)


def tag_text(df: DataFrame, column: str, library: Library) -> DataFrame:
    """row_num, technique_id of the techniques that a text names by a whole phrase, found by one automaton of all phrases."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text(f"`{column}`")), "[^0-9a-z]+", " ")), F.lit(" "))
    terms = _terms(library)
    ids = sorted({t for t, _ in terms})
    number = {t: i for i, t in enumerate(ids)}
    shared = df.sparkSession.sparkContext.broadcast((Automaton([f" {p} " for _, p in terms]), np.array([number[t] for t, _ in terms], np.int64), pa.array(ids)))

    def tag(batches):
        automaton, of, names = shared.value
        for batch in batches:
            cell, pattern, _ = automaton.scan(*spans(batch.column(1)))
            if len(cell):
                told = np.unique(np.stack([cell, of[pattern]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(told[:, 0])), names.take(pa.array(told[:, 1]))], names=["row_num", "technique_id"])

    return df.select("row_num", words.alias("_words")).mapInArrow(tag, f"row_num {dict(df.dtypes)['row_num']}, technique_id string")
