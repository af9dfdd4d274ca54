"""Rule extraction.

Each document row meets its template's prepared rules by a join on template_id and evaluates them in
place, so the text is never copied per rule and never shuffled when the rules are broadcast.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.functions.exprs import WHITE_CLASS, built_once, let, materialise, strip_edges, strip_unicode
from docloom.functions.patterns import ANCHOR, SEARCH, never_empty, within_line
from docloom.operators.dimension import PREPARED_RULE, Dimension, as_dimension, literals
from docloom.schemas import VALUE
from docloom.session import through_table

VALUES = f"array<{VALUE}>"
# The default date formats %d.%m.%Y, %d.%m.%y, %Y-%m-%d and %d/%m/%Y, tried in this
# order, each with its rearrangement to year-month-day.
_DAY, _MONTH = "(3[0-1]|[1-2][0-9]|0[1-9]|[1-9]| [1-9])", "(1[0-2]|0[1-9]|[1-9])"
DEFAULT_DATES = [
    (rf"\A{_DAY}\.{_MONTH}\.([0-9]{{4}}|[0-9]{{2}})\z", "$3-$2-$1"),
    (rf"\A([0-9]{{4}})-{_MONTH}-{_DAY}\z", "$1-$2-$3"),
    (rf"\A{_DAY}/{_MONTH}/([0-9]{{4}})\z", "$3-$2-$1"),
]


def first_capture(text: Column, regex: Column, groups: Column) -> Column:
    """First match's group 1 (whole match without groups): null without a match, "" kept."""
    return let(
        F.call_function("regexp_extract", text, regex, F.least(groups, F.lit(1))),
        lambda v: F.when(v != "", v).when(F.rlike(text, regex), F.lit("")),
    )


def clean(raw: Column, strip_chars: Column) -> Column:
    """X2. White space off, then the rule's own character set."""
    return let(
        let(raw, strip_edges),
        lambda v: F.when(strip_chars.isNotNull(), F.btrim(v, strip_chars)).otherwise(v),
    )


def _calendar_date(ymd: Column) -> Column:
    """y-m-d text to an ISO date, null when there is no such day; 69-99 are 19xx."""
    century = F.when(F.substring(ymd, 1, 2) >= "69", F.lit("19")).otherwise(F.lit("20"))
    full = F.when(ymd.rlike("^[0-9]{2}-"), F.concat(century, ymd)).otherwise(ymd)
    return F.replace(full, F.lit(" "), F.lit("")).try_cast("date").cast("string")


def _date_parts(raw: Column, date_re: str | None, date_repl: str | None) -> Column:
    """The y-m-d text that ``parse_date`` reads, null where no format fits; the default formats exclude each other."""
    own = [(date_re, date_repl)] if date_re is not None else DEFAULT_DATES
    return F.coalesce(*[F.when(raw.rlike(p), F.regexp_replace(raw, p, r)) for p, r in own])


def parse_date(raw: Column, date_re: Column | None = None, date_repl: Column | None = None) -> Column:
    """X3. ISO date, or the raw text when nothing parses; empty is null."""
    defaults = [
        F.when(raw.rlike(p), _calendar_date(F.regexp_replace(raw, p, r))) for p, r in DEFAULT_DATES
    ]
    parsed = F.coalesce(*defaults)
    if date_re is not None:
        own = F.when(F.rlike(raw, date_re), _calendar_date(F.regexp_replace(raw, date_re, date_repl)))
        parsed = F.when(date_re.isNotNull(), own).otherwise(parsed)
    return F.when(raw != "", F.coalesce(parsed, raw))


def parse_decimal(raw: Column) -> Column:
    """X4. German number to double; null when it is none."""
    return let(decimal_text(raw), _decimal)


def decimal_text(raw: Column) -> Column:
    return strip_unicode(F.translate(F.translate(raw, "._", ""), ",", "."))


def _decimal(v: Column) -> Column:
    return (
        F.when(v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), v.try_cast("double"))
        .when(v.rlike(r"(?i)^\+?inf(inity)?$"), F.lit(float("inf")))
        .when(v.rlike(r"(?i)^-inf(inity)?$"), F.lit(float("-inf")))
        .when(v.rlike(r"(?i)^[+-]?nan[0-9]*$"), F.lit(float("nan")))
    )


def integer_text(raw: Column) -> Column:
    return F.translate(raw, ".,", "")


def parse_integer(raw: Column) -> Column:
    """X5. Both separators removed; null when it is no 64-bit integer."""
    return _integer(strip_unicode(integer_text(raw)))


def _integer(v: Column) -> Column:
    return F.when(v.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.translate(v, "_", "").try_cast("bigint"))


def all_matches(text: Column, regex: Column, groups: Column) -> Column:
    """X6. Every match unstripped: the whole match, its one group, or all groups as a JSON array."""
    single = F.regexp_extract_all(text, regex, F.least(groups, F.lit(1)))
    per_group = F.transform(
        F.sequence(F.lit(1), groups), lambda g: F.regexp_extract_all(text, regex, g)
    )
    tuples = let(
        per_group,
        lambda gs: F.transform(
            F.get(gs, F.lit(0)),
            lambda _, i: F.to_json(F.transform(gs, lambda g: F.get(g, i))),
        ),
    )
    return F.when(groups > 1, tuples).otherwise(single)


def row_to_map(row: Column, columns: Column, col_idx: Column | list[int]) -> Column:
    """X9. Cells by position: missing cells "", extra cells dropped."""
    cell = lambda i: F.coalesce(F.get(row, i), F.lit(""))
    if isinstance(col_idx, list):
        return F.map_from_arrays(columns, F.array(*[cell(F.lit(i)) for i in col_idx]).cast("array<string>"))
    return F.map_from_arrays(columns, F.transform(col_idx, cell))


_ROWS = "array<map<string,string>>"


def _with_cells(rows: Column) -> Column:
    return F.filter(rows, lambda row: F.coalesce(F.exists(row, lambda c: c != ""), F.lit(False)))


def _as_maps(rows: Column, r: Column) -> Column:
    return F.transform(rows, lambda row: row_to_map(row, r["columns"], r.get("places", r["col_idx"]) if isinstance(r, dict) else r["col_idx"]))


# Most characters are visible ASCII: one range tells, before the parts of the class are tried one by one.
_GAP = f"(?![!-~]){WHITE_CLASS}{{2,}}"


def _line_cells(lines: Column) -> Column:
    """Lines cut at two or more spaces, those whose first part is empty left out."""
    return F.filter(
        F.transform(lines, lambda line: F.split(strip_edges(line), _GAP, -1)),
        lambda p: F.get(p, F.lit(0)) != "",
    )


def table_from_pages(tables: Column, r: Column) -> Column:
    """X7. First table that carries the anchor in its header and has at least one body row."""
    anchored = F.filter(
        tables,
        lambda tb: (F.size(tb) > 0)
        & (
            r["anchor"].isNull()
            | F.rlike(
                F.array_join(F.coalesce(F.get(tb, F.lit(0)), F.array().cast("array<string>")), " ", "None"),
                r["anchor"],
            )
        ),
    )

    def body(tb: Column) -> Column:
        return let(
            F.slice(tb, F.lit(2), F.size(tb) - 1),
            lambda rows: let(
                F.when(
                    r["stop"].isNotNull(),
                    F.array_position(
                        F.transform(
                            rows,
                            lambda row: F.coalesce(
                                F.exists(row, lambda c: F.rlike(c, r["stop"])), F.lit(False)
                            ),
                        ),
                        F.lit(True),
                    ),
                ).otherwise(F.lit(0)),
                lambda stop: _with_cells(
                    F.when(stop > 0, F.slice(rows, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(rows)
                ),
            ),
        )

    found = F.get(
        F.filter(F.transform(anchored, body), lambda rows: F.size(rows) > 0), F.lit(0)
    )
    return _as_maps(found, r)


def table_from_text(text: Column, r: Column) -> Column:
    """X8. Lines between the first anchor line and the next stop line, cut at two or more spaces."""

    def first_line(lines: Column, pattern: Column) -> Column:
        return F.array_position(F.transform(lines, lambda x: F.rlike(x, pattern)), F.lit(True)).cast("int")

    def between(lines: Column) -> Column:
        return let(
            first_line(lines, r["anchor"]),
            lambda a: F.when(
                a > 0,
                let(
                    F.slice(lines, a + 1, F.size(lines) - a),
                    lambda rest: let(
                        first_line(rest, r["stop"]),
                        lambda s: F.when(s > 0, F.slice(rest, F.lit(1), F.greatest(s - 1, F.lit(0)))).otherwise(rest),
                    ),
                ),
            ).otherwise(F.array().cast("array<string>")),
        )

    return _as_maps(_line_cells(let(F.split(text, "\n", -1), between)), r)


def region_pattern(r: dict) -> str | None:
    """X8 as one pattern: its group 1 is what lies between the first anchor line and the next stop line. None where that
    can't be told from the rule's patterns; then ``table_from_text`` looks at line after line."""
    if r["kind"] != "table" or not r["anchor"] or not r["stop"]:
        return None
    anchor, stop = (within_line(r[side].removeprefix(ANCHOR)) for side in ("anchor", "stop"))
    if anchor is None or stop is None:
        return None
    stop_line = stop if stop.startswith("^") and "|" not in stop else rf"^[^\n]*?(?:{stop})"
    return rf"{SEARCH}(?:{anchor})[^\n]*(?:\n([\s\S]*?)(?:{stop_line}|\z)|\z)"


def table_at(tables: Column, text: Column, r: Column, place: Column) -> Column:
    """X7, X8. The table that Python's patterns found: body rows of a page table, or lines of the text."""
    rows = _with_cells(F.slice(F.get(tables, place["at"]), F.lit(2), place["length"]))
    lines = _line_cells(F.slice(F.split(text, "\n", -1), place["first"] + 1, place["length"]))
    return F.when(place["at"].isNotNull(), _as_maps(rows, r)).when(place["first"].isNotNull(), _as_maps(lines, r))


TABLE_PLACES = "array<struct<rule_pos:int,at:int,first:int,length:int,error:string>>"


def _python_tables(texts: pd.Series, tables: pd.Series, rules: pd.Series) -> pd.Series:
    """Where the tables of rules lie whose anchor or stop only Python can run: in table ``at`` its first
    ``length`` body rows, or ``length`` lines of the text from line ``first``."""
    known: dict[str, re.Pattern] = {}

    def compiled(pattern: str | None) -> re.Pattern | None:
        if pattern and pattern not in known:
            known[pattern] = re.compile(pattern, re.IGNORECASE)
        return known[pattern] if pattern else None

    def place(text: str | None, found, rule: dict) -> dict:
        anchor, stop = compiled(rule["source_anchor"]), compiled(rule["source_stop"])
        for at, table in enumerate(found if found is not None else ()):
            if table is None or not len(table):
                continue
            header = " ".join("None" if c is None else c for c in (table[0] if table[0] is not None else ()))
            if anchor and not anchor.search(header):
                continue
            body = [row if row is not None else () for row in table[1:]]
            stops = (i for i, row in enumerate(body) if stop and any(c is not None and stop.search(c) for c in row))
            length = next(stops, len(body))
            if any(c for row in body[:length] for c in row):
                return {"at": at, "first": None, "length": length}
        if anchor and stop and text is not None:
            lines = text.split("\n")
            first = next((i + 1 for i, line in enumerate(lines) if anchor.search(line)), None)
            if first is not None:
                last = next((i for i in range(first, len(lines)) if stop.search(lines[i])), len(lines))
                return {"at": None, "first": first, "length": last - first}
        return {"at": None, "first": None, "length": None}

    def one(text, found, rule) -> dict:
        try:
            return {"rule_pos": rule["rule_pos"], **place(text, found, rule), "error": None}
        except Exception as exc:
            return {"rule_pos": rule["rule_pos"], "at": None, "first": None, "length": None, "error": str(exc)}

    return pd.Series(
        [None if rs is None else [one(t, f, r) for r in rs] for t, f, rs in zip(texts, tables, rules)], dtype=object
    )


PYTHON_RESULTS = "array<struct<rule_pos:int,s:string,l:array<string>,error:string>>"


def _python_rules(texts: pd.Series, rules: pd.Series) -> pd.Series:
    """The regex step of rules whose pattern only Python can run (or whose group may be unset)."""

    def one(text: str, rule: dict) -> dict:
        out = {"rule_pos": rule["rule_pos"], "s": None, "l": None, "error": None}
        try:
            compiled = re.compile(rule["source_regex"], re.IGNORECASE | re.MULTILINE)
            if rule["kind"] == "list":
                out["l"] = [
                    m if isinstance(m, str) else json.dumps(m, ensure_ascii=False, separators=(",", ":"))
                    for m in compiled.findall(text)
                ]
            elif found := compiled.search(text):
                out["s"] = found.group(1).strip()
                if rule["strip_chars"]:
                    out["s"] = out["s"].strip(rule["strip_chars"])
                if rule["source_format"] and out["s"]:
                    try:
                        day = datetime.datetime.strptime(out["s"], rule["source_format"])
                        out["s"] = day.strftime("%Y-%m-%d")
                    except ValueError:
                        pass
        except Exception as exc:
            out["s"], out["error"] = None, str(exc)
        return out

    return pd.Series(
        [
            None if t is None else [one(t, r) for r in rs]
            for t, rs in zip(texts, rules)
        ],
        dtype=object,
    )


def _of_rule(found: Column, r: Column) -> Column:
    return F.get(F.filter(found, lambda p: p["rule_pos"] == r["rule_pos"]), F.lit(0))


def _evaluate(
    r: Column, text: Column, tables: Column, python: Column | None, places: Column | None, captured: Column | None = None
) -> Column:
    """X1, X10. One prepared rule on one document; ``captured``: its cleaned capture, if made before."""
    kind = r["kind"]
    scalar = ~kind.isin("table", "list")
    native = clean(first_capture(text, r["regex"], r["groups"]), r["strip_chars"]) if captured is None else captured
    raw, listed = native, F.coalesce(all_matches(text, r["regex"], r["groups"]), F.array().cast("array<string>"))
    own_error = F.lit(None).cast("string")
    if python is not None:
        mine = _of_rule(python, r)
        raw = F.when(r["python_only"], mine["s"]).otherwise(native)
        listed = F.when(r["python_only"], F.coalesce(mine["l"], F.array().cast("array<string>"))).otherwise(listed)
        own_error = mine["error"]
    if places is not None:
        own_error = F.coalesce(own_error, _of_rule(places, r)["error"])
    ok = r["static_error"].isNull()

    def build(v: Column) -> Column:
        # v: struct(raw, error)
        x, err = v["raw"], v["error"]
        good = err.isNull()
        number = F.when(good & (kind == "integer") & (x != ""), parse_integer(x))
        bad_int = good & (kind == "integer") & (x != "") & number.isNull()
        table = F.coalesce(
            table_from_pages(tables, r),
            F.when(r["anchor"].isNotNull() & r["stop"].isNotNull(), table_from_text(text, r)),
            F.array().cast(_ROWS),
        )
        if places is not None:
            found = let(_of_rule(places, r), lambda place: table_at(tables, text, r, place))
            table = F.when(r["python_only"], F.coalesce(found, F.array().cast(_ROWS))).otherwise(table)
        return F.struct(
            r["rule_pos"].alias("rule_pos"),
            r["field"].alias("field"),
            kind.alias("kind"),
            F.when(good & (kind == "string"), x)
            .when(good & (kind == "date") & r["source_format"].isNotNull(), F.when(x != "", x))
            .when(good & (kind == "date"), parse_date(x, r["date_re"], r["date_repl"]))
            .alias("s"),
            F.when(good & (kind == "decimal") & (x != ""), parse_decimal(x)).alias("d"),
            number.alias("i"),
            F.when(good & (kind == "list"), listed).alias("l"),
            F.when(good & (kind == "table"), table).alias("t"),
            F.when(
                bad_int,
                F.concat(F.lit("invalid literal for int() with base 10: '"), integer_text(x), F.lit("'")),
            )
            .otherwise(err)
            .alias("error"),
        )

    no_group = ok & scalar & ~r["python_only"] & (r["groups"] == 0)
    return let(
        let(
            F.when(ok & scalar, raw),
            lambda x: F.struct(
                x.alias("raw"),
                F.when(~ok, r["static_error"])
                .when(no_group & x.isNotNull(), F.lit("no such group"))
                .otherwise(own_error)
                .alias("error"),
            ),
        ),
        build,
    )


# A template is heavy if it has more than one part in so many of all rows: fewer than so many are heavy.
HEAVY_PARTS = 256


def attach_rules(docs: DataFrame, dim: Dimension) -> DataFrame:
    """J11. Adds the matched template's prepared ``_rules`` and ``_checks`` (null on a miss).

    A bounded store arrives broadcast (its size was checked). Beyond, the matched documents are written once
    and split by the templates' measured counts: misses need no join, the documents of heavy templates meet
    their rules broadcast (as many as the byte bound allows), and only the rest is shuffled.
    """
    side = dim.prepared.select(
        "template_id", F.col("rules").alias("_rules"), F.col("checks").alias("_checks")
    )
    if dim.rows is not None:
        return docs.join(side, "template_id", "left")
    columns = ["template_id", *[c for c in docs.columns if c != "template_id"], "_rules", "_checks"]
    docs, side = through_table(docs, "matched-docs"), through_table(side, "prepared-rules")
    heavy = heavy_templates(docs, side, dim.cfg)
    known, hot = F.col("template_id").isNotNull(), F.col("template_id").isin(heavy)
    none = [F.lit(None).cast(side.schema[c].dataType).alias(c) for c in ("_rules", "_checks")]
    parts = [
        docs.filter(~known).select("*", *none).select(columns),
        docs.filter(known & ~hot).join(side.hint("merge"), "template_id", "left").select(columns),
    ]
    if heavy:
        few = F.broadcast(side.filter(hot))  # within inline_max_bytes
        parts.append(docs.filter(hot).join(few, "template_id", "left").select(columns))
    return reduce(DataFrame.unionByName, parts)


def heavy_templates(docs: DataFrame, side: DataFrame, cfg: EngineConfig) -> list[str]:
    """Ids of the heavy templates, most documents first, whose prepared rules fit the byte bound together."""
    counts = docs.filter(F.col("template_id").isNotNull()).groupBy("template_id").agg(F.count(F.lit(1)).alias("n"))
    counts = through_table(counts, "template-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    sized = counts.filter(F.col("n") * HEAVY_PARTS > total).join(side, "template_id")
    size = F.octet_length(F.to_json(F.struct("_rules", "_checks")))
    found, held = [], 0
    for r in sized.select("template_id", "n", size.alias("size")).orderBy(F.desc("n"), "template_id").collect():
        if held + r["size"] <= cfg.inline_max_bytes:
            found.append(r["template_id"])
            held += r["size"]
    return found


def apply_rules(docs: DataFrame, dim: Dimension) -> DataFrame:
    """X1. Adds ``values``: one struct per rule, in rule order; needs ``_rules`` from attach_rules."""
    with_pages = "pages" in docs.columns
    flagged = lambda tables: F.filter(
        "_rules", lambda r: r["python_only"] & r["static_error"].isNull() & ((r["kind"] == "table") == F.lit(tables))
    )
    picked = lambda r, *names: F.struct(*[r[n].alias(n) for n in names])
    if dim.needs_python:
        docs = materialise(
            docs,
            _python=F.pandas_udf(_python_rules, PYTHON_RESULTS)(
                F.when(F.size(flagged(False)) > 0, F.col("full_text")),
                F.transform(
                    flagged(False), lambda r: picked(r, "rule_pos", "kind", "source_regex", "strip_chars", "source_format")
                ),
            ),
        )
    if dim.python_tables:
        asked = F.size(flagged(True)) > 0
        docs = materialise(
            docs,
            _places=F.pandas_udf(_python_tables, TABLE_PLACES)(
                F.when(asked, F.col("full_text")),
                F.when(asked, _tables(with_pages)),
                F.when(asked, F.transform(flagged(True), lambda r: picked(r, "rule_pos", "source_anchor", "source_stop"))),
            ),
        )
    if dim.literal:
        docs = _with_captures(docs, dim.literal)
        values = _literal_values(dim.literal, dim.needs_python, dim.python_tables, with_pages)
    else:
        values = _values(dim.needs_python, dim.python_tables, with_pages)
    return materialise(docs, values=values).drop(
        "_python", "_places", *[c for c in docs.columns if c.startswith((CAPTURE, PARSED, REGION))]
    )


def _tables(with_pages: bool) -> Column:
    """All page tables of a document, in order."""
    none = F.array().cast("array<array<array<string>>>")
    if not with_pages:
        return none
    return F.coalesce(F.flatten(F.transform("pages", lambda p: F.coalesce(p["tables"], none))), none)


@built_once
def _values(with_python: bool, with_places: bool, with_pages: bool) -> Column:
    python = F.col("_python") if with_python else None
    places = F.col("_places") if with_places else None
    return let(
        _tables(with_pages),
        lambda ts: F.transform("_rules", lambda r: _evaluate(r, F.col("full_text"), ts, python, places)),
    ).cast(VALUES)


CAPTURE = "_capture_"
REGION = "_region_"


def _regions(prepared: str) -> dict[str, list[tuple[str, dict]]]:
    """(template, rule) pairs of tables whose lines one pattern finds in the text, by the column that holds those."""
    out: dict[str, list[tuple[str, dict]]] = {}
    for t in json.loads(prepared):
        for i, r in enumerate(t["rules"]):
            if not r["python_only"] and not r["static_error"] and region_pattern(r):
                out.setdefault(f"{REGION}{i}", []).append((t["template_id"], r))
    return out


def _captures(prepared: str) -> dict[str, list[tuple[str, dict]]]:
    """(template, rule) pairs with a capture that the JVM takes, by the column that holds it: one per place of a rule."""
    out: dict[str, list[tuple[str, dict]]] = {}
    for t in json.loads(prepared):
        for i, r in enumerate(t["rules"]):
            if r["kind"] not in ("table", "list") and r["regex"] and not r["python_only"] and not r["static_error"]:
                out.setdefault(f"{CAPTURE}{i}", []).append((t["template_id"], r))
    return out


def _with_captures(docs: DataFrame, prepared: str) -> DataFrame:
    """Adds the cleaned captures of each document's template. Each step is a projection that its successor reads more
    than once, so Spark keeps the steps apart and compiles them; inside ``let`` they would be interpreted."""
    found, regions = _captures(prepared), _regions(prepared)

    def of_template(name: str, value: Callable[[dict], Column | None], otherwise: Column) -> Column:
        for template_id, r in reversed((found | regions)[name]):
            own = value(r)
            otherwise = otherwise if own is None else F.when(F.col("template_id") == template_id, own).otherwise(otherwise)
        return otherwise

    text, none = F.col("full_text"), F.lit(None).cast("string")
    step = docs.withColumns(
        {c: of_template(c, lambda r: F.regexp_extract(text, r["regex"], min(r["groups"], 1)), none) for c in found}
    )
    # no match and an empty one are told apart; most captures can't be empty
    matched = lambda r: F.lit(False) if never_empty(r["source_regex"]) else F.rlike(text, F.lit(r["regex"]))
    step = step.withColumns(
        {c: F.when(F.col(c) != "", F.col(c)).when(of_template(c, matched, F.lit(False)), "") for c in found}
    )
    step = step.withColumns({c: strip_edges(F.col(c)) for c in found})
    trimmed = {
        c: of_template(c, lambda r: F.btrim(F.col(c), F.lit(r["strip_chars"])) if r["strip_chars"] else None, F.col(c))
        for c in found
    }
    trimmed |= {c: of_template(c, lambda r: F.regexp_extract(text, region_pattern(r), 1), none) for c in regions}
    return _with_parsed(materialise(step, **trimmed), found) if trimmed else step


PARSED = "_parsed_"


def _with_parsed(docs: DataFrame, found: dict[str, list[tuple[str, dict]]]) -> DataFrame:
    """Adds what the captures of dates, decimals and integers say, as ``_literal_values`` reads it: text, double, 64-bit
    integer. Two steps of plain expressions, so that both are compiled and the text a value is read from is made once."""
    texts = {
        "date": lambda c, r: _date_parts(c, r["date_re"], r["date_repl"]),
        "decimal": lambda c, r: decimal_text(c),
        "integer": lambda c, r: strip_unicode(integer_text(c)),
    }
    values = {
        "date": ("s", lambda c, v: F.when(c != "", F.coalesce(_calendar_date(v), c))),
        "decimal": ("d", lambda c, v: F.when(c != "", _decimal(v))),
        "integer": ("i", lambda c, v: F.when(c != "", _integer(v))),
    }
    read, said = {}, {}
    for name, rules in found.items():
        own = [(t, r) for t, r in rules if r["kind"] in texts]
        text = f"{PARSED}{name}"
        for template_id, r in own:
            asked = F.col("template_id") == template_id
            part = texts[r["kind"]](F.col(name), r)
            read[text] = read[text].when(asked, part) if text in read else F.when(asked, part)
        for kind in dict.fromkeys(r["kind"] for _, r in own):
            suffix, value = values[kind]
            asked = F.col("template_id").isin([t for t, r in own if r["kind"] == kind])
            said[f"{text}_{suffix}"] = F.when(asked, value(F.col(name), F.col(text)))
    if not read:
        return docs
    return docs.withColumns(read).withColumns(said).drop(*read)


def _compiled_value(r: dict, name: str | None, tables: Column) -> Column:
    """X1, X10. ``_evaluate`` for a rule that the JVM runs, known when the plan is made: only what its kind needs.

    ``name``: the column of its cleaned capture or of its table's lines, if it has one."""
    none = lambda kind: F.lit(None).cast(kind)
    value = {"s": none("string"), "d": none("double"), "i": none("bigint"), "l": none("array<string>"), "t": none(_ROWS)}
    error, kind, text = F.lit(r["static_error"]).cast("string"), r["kind"], F.col("full_text")
    if r["static_error"] is None:
        if kind == "list":
            regex, groups = F.lit(r["regex"]).cast("string"), F.lit(r["groups"])
            value["l"] = F.coalesce(all_matches(text, regex, groups), F.array().cast("array<string>"))
        elif kind == "table":
            known = {**literals(r, PREPARED_RULE), "places": r["col_idx"]}
            both = r["anchor"] is not None and r["stop"] is not None
            lines = _as_maps(_line_cells(F.split(F.col(name), "\n", -1)), known) if name else table_from_text(text, known)
            read = [table_from_pages(tables, known), *([lines] if both else [])]
            value["t"] = F.coalesce(*read, F.array().cast(_ROWS))
        elif name and r["groups"] == 0:
            error = F.when(F.col(name).isNotNull(), "no such group")
        elif name and kind == "string":
            value["s"] = F.col(name)
        elif name:
            part = {"date": "s", "decimal": "d", "integer": "i"}[kind]
            value[part] = F.col(f"{PARSED}{name}_{part}")
            if kind == "integer":
                error = F.when(
                    (F.col(name) != "") & value["i"].isNull(),
                    F.concat(F.lit("invalid literal for int() with base 10: '"), integer_text(F.col(name)), F.lit("'")),
                )
    return F.struct(
        F.lit(r["rule_pos"]).alias("rule_pos"),
        F.lit(r["field"]).cast("string").alias("field"),
        F.lit(kind).alias("kind"),
        *[v.alias(k) for k, v in value.items()],
        error.alias("error"),
    )


@built_once
def _literal_values(prepared: str, with_python: bool, with_places: bool, with_pages: bool) -> Column:
    """The same values with every pattern a literal: one branch per template, one expression per rule.

    Patterns are then compiled once per task; as columns they would be compiled per row.
    """
    python = F.col("_python") if with_python else None
    places = F.col("_places") if with_places else None
    tables = _tables(with_pages)
    made = {(template_id, r["rule_pos"]): name for name, rules in (_captures(prepared) | _regions(prepared)).items() for template_id, r in rules}
    branch = None
    for t in json.loads(prepared):
        values = []
        for r in t["rules"]:
            if not r["python_only"]:
                values.append(_compiled_value(r, made.get((t["template_id"], r["rule_pos"])), tables))
                continue
            fields, none = {**literals(r, PREPARED_RULE), "places": r["col_idx"]}, F.lit(None).cast("string")
            values.append(_evaluate(fields, F.col("full_text"), tables, python, places, none))
        chosen = F.array(*values).cast(VALUES)
        asked = F.col("template_id") == t["template_id"]
        branch = F.when(asked, chosen) if branch is None else branch.when(asked, chosen)
    return F.lit(None).cast(VALUES) if branch is None else branch


@built_once
def latest_per_field(column: str) -> Column:
    """X1. One value per field in first-appearance order: the last rule's value, the last error."""
    values = F.col(column)

    def pick(name: Column) -> Column:
        return let(
            F.filter(values, lambda v: v["field"] == name),
            lambda vs: let(
                F.get(vs, F.size(vs) - 1),
                lambda v: F.struct(
                    *[v[f].alias(f) for f in ("rule_pos", "field", "kind", "s", "d", "i", "l", "t")],
                    let(
                        F.filter(F.transform(vs, lambda w: w["error"]), lambda e: e.isNotNull()),
                        lambda es: F.get(es, F.size(es) - 1),
                    ).alias("error"),
                ),
            ),
        )

    names = F.array_distinct(F.transform(values, lambda v: v["field"]))
    return F.transform(names, pick)


def _fields_once(prepared: str) -> bool:
    """No template names a field twice (or none): then the latest value per field is the value."""
    named = [[r["field"] for r in t["rules"]] for t in json.loads(prepared)]
    return all(len(set(fields)) == len(fields) and None not in fields for fields in named)


def extract(
    matched: DataFrame, store: DataFrame | Dimension, cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """Apply each document's matched template: adds ``values`` and ``data`` (latest per field)."""
    dim = as_dimension(store, cfg)
    applied = apply_rules(attach_rules(matched, dim), dim)
    if dim.literal and _fields_once(dim.literal):
        return applied.withColumn("data", F.col("values"))
    return materialise(applied, data=latest_per_field("values"))


def long_form(extracted: DataFrame, column: str = "values") -> DataFrame:
    """D9. One row per (document, rule)."""
    return extracted.select("doc_id", "template_id", F.inline(column))
