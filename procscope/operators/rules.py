"""User rules: single-event matches and ordered sequences, written in YAML."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from functools import reduce

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope import schema as S
from procscope.functions import events as X
from procscope.operators.graph import lineage_rows
from procscope.operators.scan import chunk_of, next_rows, over, reachable
from procscope.session import materialize

# Names a rule may use. Listening sockets are not among them.
RULE_EVENTS = {n: c for c, n in S.EVENT_NAMES.items() if n != "sock_listen"}
DEFAULT_WITHIN_NS = 60_000_000_000
RULE_ORD = 64  # rule signals follow the built-in ones of an event


class RuleError(ValueError):
    pass


def parse_duration_ns(text: str) -> int | None:
    """``30s``, ``500ms`` or ``2m`` in nanoseconds, None if it is neither."""
    text = text.strip()
    for suffix, unit in (("ms", 1_000_000), ("s", 1_000_000_000), ("m", 60_000_000_000)):
        if text.endswith(suffix):
            number = text[: -len(suffix)].strip()
            return int(number) * unit if number.isascii() and number.isdigit() else None
    return None


@dataclass(frozen=True)
class Condition:
    event: str
    filename_equals: str | None = None
    filename_prefix: str | None = None
    filename_contains: str | None = None
    comm_equals: str | None = None
    uid: int | None = None
    euid: int | None = None
    to_root: bool | None = None
    gained_suid: bool | None = None
    exec_source: str | None = None
    in_container: bool | None = None

    def test(self) -> str:
        """The condition as a boolean expression; every field given must hold."""
        q = X.quote
        parts = [f"type = {RULE_EVENTS[self.event]}"]
        if self.filename_equals is not None:
            parts.append(f"filename = {q(self.filename_equals)}")
        if self.filename_prefix is not None:
            parts.append(f"startswith(filename, {q(self.filename_prefix)})")
        if self.filename_contains is not None:
            parts.append(f"contains(filename, {q(self.filename_contains)})")
        if self.comm_equals is not None:
            parts.append(f"comm = {q(self.comm_equals)}")
        if self.uid is not None:
            parts.append(f"uid = {int(self.uid)}")
        if self.euid is not None:
            parts.append(f"euid = {int(self.euid)}")
        if self.to_root:
            parts.append("old_euid <> 0 AND euid = 0")
        if self.gained_suid:
            parts.append(f"{X.gained_bits()} <> 'none'")
        if self.exec_source is not None:
            parts.append(f"{X.exec_source()} = {q(self.exec_source)}")
        if self.in_container is not None:
            parts.append("container <> ''" if self.in_container else "container = ''")
        return "(" + " AND ".join(f"({p})" for p in parts) + ")"


@dataclass(frozen=True)
class Rule:
    name: str
    score: int
    id: str = ""
    attack: tuple[str, ...] = ()
    description: str = ""
    match: Condition | None = None
    sequence: tuple[Condition, ...] = field(default_factory=tuple)
    scope: str = "same_process"
    within: str | None = None

    @property
    def signal_id(self) -> str:
        return self.id or self.name

    @property
    def within_ns(self) -> int:
        parsed = parse_duration_ns(self.within) if self.within is not None else None
        return DEFAULT_WITHIN_NS if parsed is None else parsed

    @property
    def detail(self) -> str:
        return self.description or self.name


def _condition(name: str, raw: object) -> Condition:
    if not isinstance(raw, dict) or "event" not in raw:
        raise RuleError(f"rule '{name}': a condition needs an `event`")
    unknown = set(raw) - {f.name for f in fields(Condition)}
    if unknown:
        raise RuleError(f"rule '{name}': unknown field '{sorted(unknown)[0]}'")
    if raw["event"] not in RULE_EVENTS:
        raise RuleError(f"rule '{name}': unknown event type '{raw['event']}'")
    return Condition(**raw)


def parse_rule(raw: dict) -> Rule:
    name = raw.get("name")
    if not name or "score" not in raw:
        raise RuleError(f"rule '{name}': needs a `name` and a `score`")
    unknown = set(raw) - {f.name for f in fields(Rule)}
    if unknown:
        raise RuleError(f"rule '{name}': unknown field '{sorted(unknown)[0]}'")
    match, sequence = raw.get("match"), raw.get("sequence") or []
    if match is None and not sequence:
        raise RuleError(f"rule '{name}': needs a `match` or a `sequence`")
    if match is not None and sequence:
        raise RuleError(f"rule '{name}': has both `match` and `sequence` (pick one)")
    within = raw.get("within")
    if within is not None and parse_duration_ns(str(within)) is None:
        raise RuleError(f"rule '{name}': bad duration '{within}'")
    scope = raw.get("scope", "same_process")
    if scope not in ("same_process", "same_lineage"):
        raise RuleError(f"rule '{name}': unknown scope '{scope}'")
    return Rule(
        name=name,
        score=int(raw["score"]),
        id=raw.get("id") or "",
        attack=tuple(raw.get("attack") or ()),
        description=raw.get("description") or "",
        match=_condition(name, match) if match is not None else None,
        sequence=tuple(_condition(name, c) for c in sequence),
        scope=scope,
        within=str(within) if within is not None else None,
    )


def load_rules(directory: str) -> list[Rule]:
    """All rules of a folder, in file name order; the first invalid one is an error."""
    out = []
    for entry in sorted(os.listdir(directory)):
        if not entry.endswith((".yaml", ".yml")):
            continue
        with open(os.path.join(directory, entry), encoding="utf-8") as f:
            raw = yaml.safe_load(f)
        if not isinstance(raw, dict):
            raise RuleError(f"parsing {entry}: not a rule")
        out.append(parse_rule(raw))
    return out


_QUOTED = "concat({}, ' ', char(39), {}, char(39))".format


def check_rules(texts: DataFrame, column: str = "rule") -> DataFrame:
    """Add ``error`` to rows that hold a rule as JSON text: what ``parse_rule`` would refuse it for, null
    for a valid rule. For the rule store of a fleet, where rules are rows and not files of a folder."""

    def field(of: str, name: str) -> str:
        return f"get_json_object({of}, '$.{name}')"

    def unknown(keys: str, known: list) -> str:
        return f"array_except({keys}, array({', '.join(X.quote(k) for k in known)}))"

    events = ", ".join(X.quote(e) for e in RULE_EVENTS)
    odd = unknown("json_object_keys(c)", [f.name for f in fields(Condition)])
    event = field("c", "event")
    condition = (
        f"CASE WHEN {event} IS NULL THEN 'a condition needs an `event`'"
        f" WHEN size({odd}) > 0 THEN {_QUOTED(X.quote('unknown field'), f'array_min({odd})')}"
        f" WHEN {event} NOT IN ({events}) THEN {_QUOTED(X.quote('unknown event type'), event)} END"
    )
    d = texts.selectExpr(
        "*", f"json_object_keys({column}) AS _keys", f"{field(column, 'match')} AS _match",
        f"coalesce(from_json({field(column, 'sequence')}, 'array<string>'), array()) AS _steps",
    )
    extra = unknown("_keys", [f.name for f in fields(Rule)])
    within, scope = field(column, "within"), field(column, "scope")
    conditions = f"transform(concat(array_compact(array(_match)), _steps), c -> {condition})"
    error = (
        "CASE WHEN _keys IS NULL THEN 'not a rule'"
        f" WHEN coalesce({field(column, 'name')}, '') = '' OR {field(column, 'score')} IS NULL"
        " THEN 'needs a `name` and a `score`'"
        f" WHEN size({extra}) > 0 THEN {_QUOTED(X.quote('unknown field'), f'array_min({extra})')}"
        " WHEN _match IS NULL AND size(_steps) = 0 THEN 'needs a `match` or a `sequence`'"
        " WHEN _match IS NOT NULL AND size(_steps) > 0 THEN 'has both `match` and `sequence` (pick one)'"
        f" WHEN {within} IS NOT NULL AND NOT {within} RLIKE '^ *[0-9]+ *(ms|s|m) *$'"
        f" THEN {_QUOTED(X.quote('bad duration'), within)}"
        f" WHEN coalesce({scope}, 'same_process') NOT IN ('same_process', 'same_lineage')"
        f" THEN {_QUOTED(X.quote('unknown scope'), scope)}"
        f" ELSE get(array_compact({conditions}), 0) END"
    )
    return d.selectExpr(*texts.columns, f"{error} AS error")


def listing(spark, rules: list[Rule]) -> DataFrame:
    """What is loaded: one row per rule."""
    rows = [
        (
            r.id or "-",
            r.name,
            int(r.score),
            f"sequence[{len(r.sequence)}]" if r.sequence else "match",
            ", ".join(r.attack),
        )
        for r in rules
    ]
    return spark.createDataFrame(
        rows, "id string, name string, score long, kind string, attack string"
    )


# --- evaluation -----------------------------------------------------------------------------------


def any_step(rules: list[Rule]) -> str:
    tests = [c.test() for r in rules for c in ([r.match] if r.match else r.sequence)]
    return X.any_of(tests)


def _signal_rows(d: DataFrame, index: int, r: Rule) -> DataFrame:
    attack = ", ".join(X.quote(a) for a in r.attack)
    return d.selectExpr(
        "host", "seq", f"{RULE_ORD + index} AS ord", f"{X.quote(r.signal_id)} AS id",
        f"{int(r.score)}L AS score", f"CAST(array({attack}) AS ARRAY<STRING>) AS attack",
        f"{X.quote(r.detail)} AS detail", "ts_ns", "pid", "start",
        "CAST(NULL AS STRING) AS target",
    )


def match_signals(capture: DataFrame, rules: list[Rule]) -> DataFrame | None:
    """All match rules in one pass over the capture: in one projection, or looked up if they are many
    (``looked_up_signals``), so that a plan never grows with the rules."""
    numbered = [(i, r) for i, r in enumerate(rules) if r.match is not None]
    if not numbered:
        return None
    if len(numbered) > IN_PLAN:
        return looked_up_signals(capture, rules)
    structs = []
    for i, r in numbered:
        attack = ", ".join(X.quote(a) for a in r.attack)
        structs.append(
            f"CASE WHEN {r.match.test()} THEN named_struct('ord', {RULE_ORD + i},"
            f" 'id', {X.quote(r.signal_id)}, 'score', {int(r.score)}L,"
            f" 'attack', CAST(array({attack}) AS ARRAY<STRING>),"
            f" 'detail', {X.quote(r.detail)}) END"
        )
    return (
        capture.filter(X.any_of([r.match.test() for _, r in numbered]))
        .selectExpr(
            "host", "seq", "ts_ns", "tgid AS pid", "start_boottime AS start",
            f"explode(array_compact(array({', '.join(structs)}))) AS s",
        )
        .selectExpr(
            "host", "seq", "s.ord AS ord", "s.id AS id", "s.score AS score",
            "s.attack AS attack", "s.detail AS detail", "ts_ns", "pid", "start",
            "CAST(NULL AS STRING) AS target",
        )
    )


# --- many match rules ----------------------------------------------------------------------------

IN_PLAN = 32  # match rules that one projection evaluates; more are looked up
RULE_COLUMNS = (
    "place int, id string, score long, attack array<string>, detail string, type int, how string,"
    " part string, filename_equals string, filename_prefix string, filename_contains string,"
    " comm_equals string, uid long, euid long, to_root boolean, gained_suid boolean,"
    " exec_source string, in_container boolean"
)


def _rule_key(c: Condition) -> tuple[str, str]:
    """How an event finds the rule: by the most telling value that the rule fixes."""
    if c.filename_equals is not None:
        return "filename", c.filename_equals
    if c.comm_equals is not None:
        return "comm", c.comm_equals
    if c.filename_prefix:
        return f"prefix {len(c.filename_prefix)}", c.filename_prefix
    if c.filename_contains is not None and len(c.filename_contains) >= 3:
        return "gram", c.filename_contains[:3]
    for name in ("uid", "euid"):
        if getattr(c, name) is not None:
            return name, str(int(getattr(c, name)))
    return "any", ""


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    """RULE_COLUMNS of the match rules; a rule's place in the list is its number."""
    rows = []
    for i, r in enumerate(rules):
        if (c := r.match) is None:
            continue
        how, part = _rule_key(c)
        rows.append(
            (i, r.signal_id, int(r.score), list(r.attack), r.detail, RULE_EVENTS[c.event], how, part,
             c.filename_equals, c.filename_prefix, c.filename_contains, c.comm_equals,
             None if c.uid is None else int(c.uid), None if c.euid is None else int(c.euid),
             c.to_root, c.gained_suid, c.exec_source, c.in_container)
        )
    return spark.createDataFrame(rows, RULE_COLUMNS)


def _lookups(ways: list[str]) -> str:
    """SQL array of the (how, part) by which an event may find rules: one for each way that rules use."""
    out = []
    for way in ways:
        value = {
            "filename": "filename", "comm": "comm", "uid": "CAST(uid AS STRING)",
            "euid": "CAST(euid AS STRING)", "any": "''",
        }.get(way)
        if way.startswith("prefix "):
            value = f"left(filename, {int(way.split()[1])})"
        if way == "gram":
            grams = "transform(sequence(1, length(filename) - 2), i -> substring(filename, i, 3))"
            out.append(
                f"if(length(filename) < 3, array(), transform(array_distinct({grams}),"
                " g -> struct('gram' AS how, g AS part)))"
            )
        else:
            out.append(f"array(struct({X.quote(way)} AS how, {value} AS part))")
    return f"flatten(array({', '.join(out)}))"


def looked_up_signals(capture: DataFrame, rules: list[Rule]) -> DataFrame:
    """As ``match_signals`` for any number of rules, with a plan that does not grow with them: rules are
    rows under an event type and an exact value, a prefix or a few letters, events look up those under
    their own values, and only what is found is tested."""
    table = rule_table(capture.sparkSession, rules)
    kinds: dict[int, set[str]] = {}
    for r in rules:
        if r.match is not None:
            kinds.setdefault(RULE_EVENTS[r.match.event], set()).add(_rule_key(r.match)[0])
    arms = " ".join(
        f"WHEN {type_} THEN {_lookups(sorted(ways))}" for type_, ways in sorted(kinds.items())
    )
    types = ", ".join(str(t) for t in sorted(kinds))
    events = capture.filter(f"type IN ({types})").selectExpr(
        "host", "seq", "ts_ns", "tgid AS pid", "start_boottime AS start", "type",
        "struct(filename, comm, uid, euid, old_euid, container,"
        f" {X.gained_bits()} AS gained, {X.exec_source()} AS source) AS e",
        f"explode(CASE type {arms} END) AS k",
    ).selectExpr("*", "k.how AS how", "k.part AS part").drop("k")
    found = events.join(table, ["type", "how", "part"])
    tests = [
        "filename_equals IS NULL OR e.filename = filename_equals",
        "filename_prefix IS NULL OR startswith(e.filename, filename_prefix)",
        "filename_contains IS NULL OR contains(e.filename, filename_contains)",
        "comm_equals IS NULL OR e.comm = comm_equals",
        "uid IS NULL OR e.uid = uid",
        "euid IS NULL OR e.euid = euid",
        "NOT coalesce(to_root, false) OR (e.old_euid <> 0 AND e.euid = 0)",
        "NOT coalesce(gained_suid, false) OR e.gained <> 'none'",
        "exec_source IS NULL OR e.source = exec_source",
        "in_container IS NULL OR in_container = (e.container <> '')",
    ]
    return found.filter(" AND ".join(f"({t})" for t in tests)).selectExpr(
        "host", "seq", f"{RULE_ORD} + place AS ord", "id", "score", "attack", "detail", "ts_ns", "pid",
        "start", "CAST(NULL AS STRING) AS target",
    )


def steps_of(capture: DataFrame, r: Rule, reach: DataFrame | None) -> DataFrame:
    """Rows matching any step of a sequence, with the matched steps as a bit mask and the scope they
    count in: the process itself, or the oldest known node of its lineage at that moment."""
    mask = " | ".join(f"if({c.test()}, {1 << i}, 0)" for i, c in enumerate(r.sequence))
    d = capture.selectExpr(
        "host", "seq", "ts_ns", "tgid AS pid", "start_boottime AS start", f"({mask}) AS steps"
    ).filter("steps <> 0")
    if r.scope == "same_process":
        return d
    nodes = lineage_rows(d, reach)
    return (
        nodes.groupBy("host", "seq", "ts_ns", "steps")
        .agg(F.expr("max_by(apid, depth) AS pid"), F.expr("max_by(astart, depth) AS start"))
        .select("host", "seq", "ts_ns", "pid", "start", "steps")
    )


def disjoint(r: Rule) -> bool:
    """Can no event match both the first step and a later one? Event types decide that safely."""
    return all(c.event != r.sequence[0].event for c in r.sequence[1:])


def sequence_completions(d: DataFrame, r: Rule, chunk: int | None = None) -> DataFrame:
    """Rows of ``steps_of`` at which the sequence completes: (host, pid, start, seq, ts_ns).

    One attempt is in flight per scope. An event that matches the next step advances it; any other
    event matching the first step starts over; an attempt older than the window is dropped.
    """
    if len(r.sequence) == 1:
        return d.select(*S.KEY, "seq", "ts_ns")
    if len(r.sequence) == 2 and disjoint(r):
        # With two steps that exclude each other, every first-step row restarts the attempt. So a
        # second-step row completes it exactly when the row before it is a first step in time.
        return _pairs(d, r.within_ns, chunk)
    return sequence_scan(d, r, chunk)[0]


def _pairs(d: DataFrame, within_ns: int, chunk: int | None) -> DataFrame:
    row = "struct(steps, ts_ns)"
    ck = S.KEY + ["_chunk"]
    c = d.selectExpr("*", f"{chunk_of('seq', chunk)} AS _chunk").repartition(*ck)
    tails = c.groupBy(*ck).agg(F.expr(f"max_by({row}, seq) AS tail"))
    tails = tails.selectExpr(*ck, f"lag(tail) {over(S.KEY, '_chunk')} AS carry")
    p = c.selectExpr("*", f"lag({row}) {over(ck, 'seq')} AS inside")
    p = p.join(tails, ck, "left").selectExpr(*d.columns, "coalesce(inside, carry) AS prev")
    return p.filter(
        f"steps = 2 AND prev.steps = 1 AND ts_ns - prev.ts_ns <= {within_ns}L"
    ).select(*S.KEY, "seq", "ts_ns")


def sequence_scan(
    d: DataFrame, r: Rule, chunk: int | None = None, in_flight: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(completions, attempts in flight at the end) of any sequence, over rows of ``steps_of``.

    Every row that matches the first step may begin an attempt, and what becomes of an attempt follows
    from the row alone: of the rows after it only the next one that matches the step awaited or the
    first step counts, and the newest time on the way says whether the window has closed by then. So
    each possible attempt gets its end and the row where the next attempt would begin, step by step by
    equality joins. Which attempts really happen is a walk from the first one along those rows. A row
    that matches nothing but the first step always begins an attempt; only others need to be
    reached, by doubling jumps. No key is walked through in one task.

    ``in_flight``: (host, pid, start, seq, first_ts, step) of earlier batches, at most one for a scope.
    """
    n, within = len(r.sequence), r.within_ns
    rows = d.selectExpr(*S.KEY, "seq", "ts_ns", "steps", "0 AS at_step", "ts_ns AS first_ts")
    if in_flight is not None:
        rows = rows.unionByName(
            in_flight.selectExpr(*S.KEY, "seq", "first_ts AS ts_ns", "0 AS steps", "step AS at_step", "first_ts")
        )
    if n == 1:
        return d.select(*S.KEY, "seq", "ts_ns"), rows.selectExpr(*S.KEY, "seq", "first_ts", "0 AS step").limit(0)
    rows = next_rows(rows, S.KEY, {"z": "(steps & 1) <> 0"}, "struct(seq, steps)", size=chunk)
    tests = {f"n{k}": f"(steps & {1 << k | 1}) <> 0" for k in range(1, n)}
    value = "struct(seq, ts_ns, steps, z)"
    rows = materialize(next_rows(rows, S.KEY, tests, value, "ts_ns", size=chunk), "sequence-rows")

    def awaiting(k: int, which: str) -> DataFrame:
        return rows.filter(which).selectExpr(
            *S.KEY, "seq AS begun", "steps AS own", "first_ts", f"n{k} AS n", f"n{k}_peak AS peak"
        )

    ends, now = None, awaiting(1, "at_step = 0 AND (steps & 1) <> 0")
    for k in range(1, n):
        if in_flight is not None:
            now = now.unionByName(awaiting(k, f"at_step = {k}"))
        now = now.selectExpr(
            "*",
            f"CASE WHEN peak - first_ts > {within}L THEN 'closed' WHEN n IS NULL THEN 'open'"
            f" WHEN (n.steps & {1 << k}) <> 0 THEN '{'done' if k == n - 1 else 'on'}' ELSE 'again' END AS kind",
        )
        here = "(kind = 'again' OR (kind = 'closed' AND (n.steps & 1) <> 0))"
        then = "kind = 'closed' OR kind = 'done'"
        part = now.filter("kind <> 'on'").selectExpr(
            *S.KEY, "begun", "own", "first_ts", f"{k} AS step", "kind", "n.seq AS seq", "n.ts_ns AS ts_ns",
            f"CASE WHEN {here} THEN n.seq WHEN {then} THEN n.z.seq END AS nxt",
            f"CASE WHEN {here} THEN n.steps WHEN {then} THEN n.z.steps END AS nxt_steps",
        )
        ends = part if ends is None else ends.unionByName(part)
        if k < n - 1:
            there = rows.selectExpr(*S.KEY, "seq", f"n{k + 1}", f"n{k + 1}_peak")
            now = now.filter("kind = 'on'").selectExpr(*S.KEY, "n.seq AS seq", "begun", "own", "first_ts")
            now = now.join(there, [*S.KEY, "seq"]).selectExpr(
                *S.KEY, "begun", "own", "first_ts", f"n{k + 1} AS n", f"n{k + 1}_peak AS peak"
            )
    ends = materialize(ends, "attempts")
    first = ends.groupBy(*S.KEY).agg(F.min("begun").alias("begun"))
    roots = ends.filter("own = 1").select(*S.KEY, "begun").unionByName(first)
    jump = ends.filter("nxt_steps <> 1")
    real = ends.join(reachable(roots, jump, S.KEY, "begun", "attempts-begun"), [*S.KEY, "begun"])
    real = materialize(real, "attempts-made")
    return (
        real.filter("kind = 'done'").select(*S.KEY, "seq", "ts_ns"),
        real.filter("kind = 'open'").selectExpr(*S.KEY, "begun AS seq", "first_ts", "step"),
    )


def rule_signals(
    capture: DataFrame, rules: list[Rule], reach: DataFrame | None, chunk: int | None = None
) -> DataFrame:
    """Signals of all rules, numbered after the built-in ones."""
    parts = []
    m = match_signals(capture, rules)
    if m is not None:
        parts.append(m)
    for i, r in enumerate(rules):
        if r.sequence:
            done = sequence_completions(steps_of(capture, r, reach), r, chunk)
            parts.append(_signal_rows(done, i, r))
    return reduce(DataFrame.unionByName, parts)


IN_FLIGHT = "host string, pid long, start long, seq long, first_ts long, step int, rule int"


def resumed_signals(
    capture: DataFrame,
    rules: list[Rule],
    reach: DataFrame | None,
    in_flight: DataFrame | None,
    chunk: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """As ``rule_signals`` for a part of a stream: goes on with the attempts ``in_flight`` (IN_FLIGHT),
    and returns those that are so at the end of the part. A rule is known by its place in the list."""
    m = match_signals(capture, rules)
    parts, left = [] if m is None else [m], [capture.sparkSession.createDataFrame([], IN_FLIGHT)]
    for i, r in enumerate(rules):
        if r.sequence:
            had = None if in_flight is None else in_flight.filter(f"rule = {i}").drop("rule")
            done, open_ = sequence_scan(steps_of(capture, r, reach), r, chunk, had)
            parts.append(_signal_rows(done, i, r))
            left.append(open_.withColumn("rule", F.lit(i)))
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, left)
