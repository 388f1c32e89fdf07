"""Reading strategy scripts: calls with balanced arguments, assignments, conditions and what names are bound to.

One tokenizer finds strings, comments, names and brackets; everything else asks for the calls it found. Outside of the calls that
are asked for it only looks for strings, comments and names of calls, so that most of a text is passed over by the pattern alone.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterable, Iterator
from dataclasses import dataclass

from tidemark.functions.rules import RuleError, rule_identifiers

_SKIP = r"""(?P<skip>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|//[^\n]*)"""
_TOKEN = re.compile(rf"{_SKIP}|(?P<name>[A-Za-z_][\w.]*)|(?P<mark>[()\[\],?:])")
# A name starts where no letter stands before it; after a digit or a dot it is the rest of a name that was already tried.
_CALLED = re.compile(rf"{_SKIP}|(?<![A-Za-z_])(?P<name>[A-Za-z_][\w.]*+)\s*+\(")
_INSIDE = re.compile(rf"{_SKIP}|(?<![A-Za-z_])(?P<name>[A-Za-z_][\w.]*+)\s*+\(|(?P<mark>[()\[\],])")
_NAME = re.compile(r"[A-Za-z_]\w*")
#: Lines that an assignment may go on for.
GOES_ON = 10
# Words of a side in alert conditions and in the styling of markers, display switches, words that are no condition.
BULL, BEAR = r"bull|long|buy|\bup\b|cross.*over", r"bear|short|sell|\bdown\b|cross.*under"
MARK_BULL, MARK_BEAR = "buy|long|bull|belowbar|triangleup|labelup|arrowup", "sell|short|bear|abovebar|triangledown|labeldown|arrowdown"
SWITCH = r"(show|hide|draw|display|enable|disable)\w*"
NO_CONDITION = ("true", "false", "na")
# Calls that say an entry.
ENTRY_CALLS = frozenset(("strategy.entry", "alertcondition", "plotshape", "plotchar", "plotarrow"))
# What makes a condition evaluable.
EVALUABLE = r"(?i)[<>]=?|[!=]==?|\bta\.|\b(and|or|not)\b|\bcross"


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[str, ...]
    start: int
    end: int

    def named(self, key: str) -> str | None:
        """The value of an argument `key = value`."""
        found = (re.match(rf"{key}\s*=(?!=)\s*(.*)", a, re.S) for a in self.args)
        return next((m[1].strip() for m in found if m), None)


def calls(text: str, names: Container[str] | None = None) -> list[Call]:
    """The calls whose brackets close, inner ones too, by their start; with `names`, only those of these names."""
    found: list[Call] = []
    open_: list[tuple[str, int, list[int]]] = []  # name, start, where its arguments are cut
    at = 0
    while m := (_INSIDE if open_ or names is None else _CALLED).search(text, at):
        at = m.end()
        name, mark = m["name"], m.lastgroup == "mark" and m["mark"]
        if name is not None:
            wanted = names is None or name in names
            if wanted or open_:
                open_.append((name if wanted else "", m.start(), [at - 1]))
        elif mark in ("(", "["):
            open_.append(("", m.start(), [m.start()]))
        elif open_ and mark == ",":
            open_[-1][2].append(m.start())
        elif open_ and mark in (")", "]"):
            title, start, cuts = open_.pop()
            if title:
                edges = [*cuts, m.start()]
                found.append(Call(title, tuple(text[a + 1 : b].strip() for a, b in zip(edges, edges[1:])), start, at))  # noqa: B905
    return sorted(found, key=lambda c: c.start)


def choices(expression: str) -> list[str]:
    """The two values of a conditional expression, or the expression itself."""
    depth, at = 0, {}
    for m in _TOKEN.finditer(expression):
        mark = m["mark"]
        depth += (mark in ("(", "[")) - (mark in (")", "]"))
        if not depth and mark in ("?", ":"):
            at.setdefault(mark, m.start())
    if at.get("?", 1 << 60) < at.get(":", -1):
        return [expression[at["?"] + 1 : at[":"]].strip(), expression[at[":"] + 1 :].strip()]
    return [expression.strip()]


_ASSIGN = re.compile(r"^[ \t]*(?:var[^\S\n]+|varip[^\S\n]+)?(?:bool[^\S\n]+|float[^\S\n]+|int[^\S\n]+)?(\w+)[^\S\n]*:?=(?!=)[^\S\n]*(.*)", re.M)
_UNFINISHED = re.compile(r"(\band|\bor|[+\-*/?:,(<>=])\s*$")
_CARRIES_ON = re.compile(r"\s+(and|or|\?|:)\b")


def assignments(text: str) -> dict[str, str]:
    """The right-hand side of the first assignment to each name, with the lines that go on from it."""
    text = re.sub(r"//.*", "", text) if "//" in text else text
    first: dict[str, re.Match[str]] = {}
    for m in _ASSIGN.finditer(text):
        first.setdefault(m[1], m)
    out: dict[str, str] = {}
    for name, m in first.items():
        whole, at = [m[2].strip()], m.end()
        while at < len(text) and len(whole) <= GOES_ON:
            end = text.find("\n", at + 1)
            more = text[at + 1 : end if end >= 0 else len(text)]
            unfinished = _UNFINISHED.search(whole[-1]) or whole[-1].count("(") > whole[-1].count(")")
            if not unfinished and not _CARRIES_ON.match(more):
                break
            whole.append(more.strip())
            at = end if end >= 0 else len(text)
        out[name] = " ".join(filter(None, whole))
    return out


def without_switches(condition: str) -> str:
    """An and-chain without its display switches, unless it is nothing else."""
    terms = [t.strip() for t in re.split(r"(?i)\s+and\s+", condition)]
    kept = [t for t in terms if not re.fullmatch(SWITCH, t, re.I)]
    return " ".join(" and ".join(kept or terms).split())


def expanded(condition: str, assigned: dict[str, str]) -> str:
    """A bare name replaced by what it is assigned, twice at most."""
    for _ in range(2):
        if not (_NAME.fullmatch(condition) and assigned.get(condition)):
            break
        condition = assigned[condition]
    return condition


def sides(items: Iterable[tuple[str, str]], bull: str, bear: str) -> tuple[list[str], list[str], list[str]]:
    """Conditions whose description speaks of the long side, of the short side (a condition may do both), and all of them."""
    items = list(items)
    speaks = lambda words: [c for c, said in items if re.search(words, said, re.I)]
    return speaks(bull), speaks(bear), [c for c, _ in items]


def _of_entries(found: list[Call]) -> tuple[str, list[str]] | None:
    entries = [(c.args[1], c.named("when")) for c in found if c.name == "strategy.entry" and len(c.args) > 1]
    entries = [(side.removeprefix("strategy."), when) for side, when in entries if side in ("strategy.long", "strategy.short") and when]
    if not entries:
        return None
    direction = "BOTH" if len(entries) > 1 else "BUY" if entries[0][0] == "long" else "SELL"
    return direction, [when for _, when in entries][:3]


def _of_alerts(found: list[Call]) -> tuple[str, list[str]]:
    given = [c.args[0] for c in found if c.name == "alertcondition" and c.args[0]]
    bull, bear, every = sides(((a, a) for a in given), BULL, BEAR)
    direction = "BOTH" if bool(bull) == bool(bear) else "BUY" if bull else "SELL"
    return direction, bull[:2] + bear[:2] if bull and bear else (bull or bear or every)[:3]


def _of_markers(found: list[Call]) -> tuple[str, list[str]] | None:
    drawn = [(c.args[0].split("?")[0].strip(), ",".join(c.args[1:]).lower()) for c in found if c.name in ("plotshape", "plotchar", "plotarrow")]
    drawn = [(s, style) for s, style in drawn if _NAME.fullmatch(s) or re.search(EVALUABLE, s)]
    drawn = [(s, style) for s, style in drawn if bool(re.search(MARK_BULL, style)) != bool(re.search(MARK_BEAR, style))]
    bull, bear, _ = sides(drawn, MARK_BULL, MARK_BEAR)
    if not drawn:
        return None
    return "BOTH" if bull and bear else "BUY" if bull else "SELL", (bull + bear)[:3]


def entry_of(text: str, assigned: dict[str, str] | None = None) -> tuple[str, list[str]]:
    """(direction, conditions): strategy entries, else alert conditions, else plotted markers; cleaned and expanded."""
    found = calls(text, ENTRY_CALLS)
    direction, conditions = _of_entries(found) or _of_alerts(found)
    if not conditions:
        direction, conditions = _of_markers(found) or (direction, [])
    if assigned is None:
        assigned = assignments(text) if conditions else {}
    read = [without_switches(expanded(without_switches(c), assigned)) for c in conditions]
    return direction, [c for c in read if c and c.lower() not in NO_CONDITION]


def bound(expression: str, parameters: Container[str], types: dict[str, str]) -> tuple[str, str | None] | None:
    """(type, period) of an expression that begins with the call of an indicator; the period is a number or a parameter's name."""
    for one in choices(expression):
        first = next((c for c in calls(one) if c.start == 0), None)
        if first and first.name == "request.security" and len(first.args) > 2:
            found = bound(first.args[2], parameters, types)
            if found:
                return found
        kind = types.get(first.name.removeprefix("ta.").lower()) if first else None
        if kind and first.args and re.fullmatch(r"[\w.\[\]]+", first.args[0]):
            period = first.args[1] if len(first.args) > 1 else None
            return kind, period if period and (period.isdigit() or period in parameters) else None
    return None


def _names(conditions: list[str]) -> Iterator[str]:
    for c in conditions:
        try:
            yield from rule_identifiers(c)
        except RuleError:
            continue


def entry_and_bindings(text: str, parameters: Container[str], types: dict[str, str]) -> tuple[str, list[str], list[tuple[str, str, str | None]]]:
    """(direction, conditions, bindings) of a script whose assignments are read once."""
    assigned = assignments(text)
    direction, conditions = entry_of(text, assigned)
    return direction, conditions, bindings_of(text, conditions, parameters, types, assigned)


def bindings_of(text: str, conditions: list[str], parameters: Container[str], types: dict[str, str], assigned: dict[str, str] | None = None) -> list[tuple[str, str, str | None]]:
    """(name, type, period) for each name in the conditions that is assigned an indicator call, one alias apart at most."""
    names, out = dict.fromkeys(n for n in _names(conditions) if "." not in n and n not in parameters), []
    if assigned is None:
        assigned = assignments(text) if names else {}
    for name in names:
        right = assigned.get(name)
        found = bound(right, parameters, types) if right else None
        if right and not found and _NAME.fullmatch(right) and assigned.get(right):
            found = bound(assigned[right], parameters, types)
        if found:
            out.append((name, *found))
    return out


# Second dialect: strategy classes over data frames.
# Indicator functions, fields of those with several outputs, functions that rules may call.
FRAME_CALLS = {"RSI": "RSI", "EMA": "EMA", "SMA": "SMA", "WMA": "WMA", "ADX": "ADX", "CCI": "CCI", "ATR": "ATR", "ROC": "ROC", "MOM": "MOM", "TRANGE": "TR"}
FRAME_FIELDS = {"macd": {"macd": "macd", "macdsignal": "signal", "macdhist": "histogram"}, "bb": {"lower": "lower", "mid": "middle", "upper": "upper"}}
FRAME_RULE_CALLS = {"ta.crossover", "ta.crossunder", "ta.cross", "nz", "abs", "min", "max", "math.abs", "math.min", "math.max", "math.sign", "barstate.isconfirmed"}
_COLUMN = r"""dataframe\[['"](\w+)['"]\]"""
# The calls that bind a column or a variable, and those that declare a parameter.
FRAME_BINDERS = frozenset(("ta.MACD", "qtpylib.bollinger_bands", *FRAME_CALLS, *(f"ta.{f}" for f in FRAME_CALLS)))
FRAME_DECLARES = frozenset(("IntParameter", "DecimalParameter", "RealParameter", "CategoricalParameter"))


def unwrapped(text: str) -> str:
    """text without brackets around the whole of it."""
    text = text.strip()
    while text.startswith("(") and text.endswith(")"):
        depth = 0
        for m in re.finditer(r"[()]", text):
            depth += 1 if m[0] == "(" else -1
            if not depth:
                break
        if depth or m.end() < len(text):
            break
        text = text[1:-1].strip()
    return text


def assigned_to(text: str, at: int) -> tuple[str | None, str | None]:
    """(column, variable) that what begins at `at` is assigned to; looks back no further than to that name."""
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    if not end or text[end - 1] != "=":
        return None, None
    end -= 1
    while end and text[end - 1].isspace():
        end -= 1
    if text.endswith("]", 0, end):
        column = re.compile(_COLUMN).fullmatch(text, max(0, text.rfind("dataframe[", 0, end)), end)
        return column and column[1], None
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] == "_"):
        start -= 1
    return None, text[start:end] or None


def methods(source: str) -> dict[str, str]:
    """The body of each method, up to the next line that is indented no deeper than its def."""
    out: dict[str, str] = {}
    for m in re.finditer(r"^([ \t]*)def\s+(\w+)\s*\(", source, re.M):
        rest = source[m.end() :]
        close = re.search(rf"^[ \t]{{0,{len(m[1].expandtabs())}}}\S", rest[rest.find("\n") + 1 :], re.M) if "\n" in rest else None
        out[m[2]] = rest[: rest.find("\n") + 1 + close.start()] if close else rest
    return out


def frame_bindings(body: str) -> tuple[dict[str, tuple[str, dict[str, str]]], dict[str, str]]:
    """Indicator columns name -> (type, parameters), and aliases of columns for the outputs of indicators with several."""
    binds: dict[str, tuple[str, dict[str, str]]] = {}
    made: dict[str, str] = {}  # variable -> binding
    for c in calls(body, FRAME_BINDERS):
        column, variable = assigned_to(body, c.start)
        if c.name == "ta.MACD" and variable:
            binds["macd"], made[variable] = ("MACD", {}), "macd"
        elif c.name == "qtpylib.bollinger_bands" and variable:
            given = {"period": c.named("window"), "stdDev": c.named("stds")}
            binds["bb"], made[variable] = ("BB", {k: v for k, v in given.items() if v and re.fullmatch(r"\d+\.?\d*", v)}), "bb"
        elif c.name.removeprefix("ta.") in FRAME_CALLS and column:
            period = c.named("timeperiod") or (c.args[1] if len(c.args) > 1 and "=" not in c.args[1] else None)
            binds[column] = (FRAME_CALLS[c.name.removeprefix("ta.")], {"period": re.sub(r"^self\.|\.value$", "", period)} if period else {})
    alias = {}
    for column, var, output in re.findall(rf"""{_COLUMN}\s*=\s*(\w+)\[['"](\w+)['"]\]""", body):
        if var in made:
            alias[column] = f"{made[var]}.{FRAME_FIELDS[made[var]].get(output, output)}"
    return binds, alias


def frame_condition(body: str, *columns: str) -> str | None:
    """The text between `dataframe.loc[` and the first of the columns that the body sets, without comments; None if it sets none."""
    for column in columns:
        m = re.search(rf"""dataframe\.loc\[(.*?),\s*\[?['"]{column}['"][^\n]*?\]\s*=\s*""", body, re.S)
        if m:
            return " ".join(re.sub(r"#[^\n]*", "", m[1]).split()).removesuffix(",").strip()
    return None


# What the parts of a data-frame expression become, in this order.
_FRAME_REWRITES = (
    (r"qtpylib\.crossed_above\s*\(", "ta.crossover("),
    (r"qtpylib\.crossed_below\s*\(", "ta.crossunder("),
    (r"\.shift\(\s*\)", "[1]"),
    (r"\.shift\(\s*(\d+)\s*\)", r"[\1]"),
    (r"self\.(\w+)(?:\.value)?", r"\1"),
    (r"&", " and "),
    (r"\|", " or "),
    (r"~", " not "),
)


def translated(condition: str, alias: dict[str, str]) -> str:
    """A data-frame condition as a rule."""
    rule = re.sub(rf"{_COLUMN}|dataframe\.(\w+)\b(?!\()", lambda m: alias.get(m[1] or m[2], m[1] or m[2]), unwrapped(condition))
    for pattern, new in _FRAME_REWRITES:
        rule = re.sub(pattern, new, rule)
    return " ".join(rule.split())


def frame_parameters(source: str) -> dict[str, str]:
    """Defaults of declared parameters, overridden by those that the dictionaries of tuned values give."""
    out = {}
    for c in calls(source, FRAME_DECLARES):
        variable, default = assigned_to(source, c.start)[1], c.named("default")
        if variable and default and re.fullmatch(r"-?[\d.]+", default):
            out[variable] = default
    for block in re.findall(r"(?:buy|sell|entry|exit)_params\s*=\s*\{(.*?)\}", source, re.S):
        out |= dict(re.findall(r"""['"](\w+)['"]\s*:\s*(-?[\d.]+)""", block))
    return out


def frame_strategy(source: str) -> dict:
    """One strategy class: name, timeframe, stop-loss, parameters, bindings, entry and exit rule, or the first reason to skip it."""
    out: dict = dict.fromkeys(("name", "timeframe", "stop_loss", "entry", "exit", "skip_reason")) | {"bindings": [], "parameters": {}}
    title = re.search(r"class\s+(\w+)\s*\(\s*IStrategy\s*\)", source or "")
    bodies = methods(source) if title else {}
    way_in = bodies.get("populate_entry_trend") or bodies.get("populate_buy_trend")
    binds, alias = frame_bindings(bodies.get("populate_indicators", ""))
    if title:
        first = lambda p: (re.search(p, source, re.M) or [None, None])[1]
        out |= {"name": title[1], "timeframe": first(r"^\s*(?:timeframe|ticker_interval)\s*=\s*['\"](\w+)['\"]"), "stop_loss": first(r"^\s*stoploss\s*=\s*(-?[\d.]+)")}
        out |= {"parameters": frame_parameters(source), "bindings": [{"name": n, "type": t, "params": p} for n, (t, p) in binds.items()]}
    rules = [frame_condition(way_in or "", "enter_long", "buy"), frame_condition(bodies.get("populate_exit_trend") or bodies.get("populate_sell_trend") or "", "exit_long", "sell")]
    # of the raw text, as the rewrites change it: all bars, or a lazy match that ran over an earlier block of another column
    unsupported = [bool(r) and (unwrapped(r) == ":" or "dataframe.loc[" in r) for r in rules]
    out["entry"], out["exit"] = (translated(r, alias) if r and not bad else None for r, bad in zip(rules, unsupported, strict=True))

    def reasons() -> Iterator[str | None]:
        yield None if title else "no strategy class"
        yield None if way_in and "populate_indicators" in bodies else "missing populate methods"
        yield None if binds else "no known indicator"
        yield None if rules[0] else "no entry condition"
        yield "unconditional or multi-block" if unsupported[0] else None  # such an exit is left out, the entry holds
        for rule in filter(None, (out["entry"], out["exit"])):
            yield "untranslated dataframe expression" if "dataframe" in rule else None
            called = [c for c in re.findall(r"([A-Za-z_][\w.]*)\s*\(", rule) if c not in ("and", "or", "not", *FRAME_RULE_CALLS)]
            yield f"unsupported call {called[0]}" if called else None

    return out | {"skip_reason": next(filter(None, reasons()), None)}
