"""Functions that are written out as Spark expressions before Spark sees the text.

Unlike SQL functions these have no types of their own: an array of numbers
stays one. ``$0``, ``$1`` ... stand for the arguments. Lambda names start with
an underscore, so that they hide no column.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..errors import QueryError
from .literals import tokens
from .registry import RENAMED

_FROM = "IF($1 < 0, greatest(size($0) + $1 + 1, 1), greatest($1, 1))"
_TO = "IF($2 < 0, size($0) + $2 + 1, $2)"
_SLICE = f"slice($0, {_FROM}, greatest({_TO} - {_FROM} + 1, 0))"
_SORTED = "sort_array(filter($0, _e -> _e IS NOT NULL), {})"
_NULLS = "filter($0, _e -> _e IS NULL)"

#: Sizes by level, read off the JSON of an array, as expressions over arrays of different depths have no one type. Three levels at most.
_INSIDE = "get(from_json({}, 'array<string>'), 0)"
_DEPTH = ["to_json($0)", _INSIDE.format("to_json($0)"), _INSIDE.format(_INSIDE.format("to_json($0)"))]
_DIMS = "IF($0 IS NULL, NULL, slice(array(" + ", ".join(f"CAST(size(from_json({d}, 'array<string>')) AS BIGINT)" for d in _DEPTH) + "), 1, size(split(typeof($0), 'array<')) - 1))"

#: (name, number of arguments) -> expression
TEMPLATES = {
    ("array_slice", 3): _SLICE,
    ("array_slice", 4): f"filter({_SLICE}, (_e, _i) -> _i % $3 = 0)",
    ("array_remove", 2): "filter($0, (_e, _i) -> _i + 1 <> array_position($0, $1))",
    ("array_remove_all", 2): "array_remove($0, $1)",
    ("array_remove_n", 3): "filter($0, (_e, _i) -> NOT (_e <=> $1) OR size(filter(slice($0, 1, _i + 1), _y -> _y <=> $1)) > $2)",
    ("array_replace", 3): "transform($0, (_e, _i) -> IF(_i + 1 = array_position($0, $1), $2, _e))",
    ("array_replace_n", 4): "transform($0, (_e, _i) -> IF(_e <=> $1 AND size(filter(slice($0, 1, _i + 1), _y -> _y <=> $1)) <= $3, $2, _e))",
    ("array_replace_all", 3): "transform($0, _e -> IF(_e <=> $1, $2, _e))",
    ("array_resize", 2): "slice(concat($0, array_repeat(NULL, greatest($1 - size($0), 0))), 1, $1)",
    ("array_resize", 3): "slice(concat($0, array_repeat($2, greatest($1 - size($0), 0))), 1, $1)",
    ("array_positions", 2): "transform(filter(sequence(1, greatest(size($0), 1)), _i -> _i <= size($0) AND try_element_at($0, _i) <=> $1), _i -> CAST(_i AS BIGINT))",
    ("array_position", 2): "nullif(array_position($0, $1), 0)",
    ("array_pop_back", 1): "slice($0, 1, greatest(size($0) - 1, 0))",
    ("array_pop_front", 1): "slice($0, 2, greatest(size($0) - 1, 0))",
    ("array_push_back", 2): "array_append($0, $1)",
    ("array_push_front", 2): "array_prepend($1, $0)",
    ("array_prepend", 2): "array_prepend($1, $0)",
    ("array_has_all", 2): "size(array_except($1, $0)) = 0",
    ("array_any_value", 1): "try_element_at(filter($0, _e -> _e IS NOT NULL), 1)",
    ("array_empty", 1): "size($0) = 0",
    ("empty", 1): "size($0) = 0",
    ("array_sort", 1): "sort_array($0)",
    ("string_to_array", 2): "split($0, concat(chr(92), 'Q', $1, chr(92), 'E'))",
    ("string_to_array", 3): "transform(split($0, concat(chr(92), 'Q', $1, chr(92), 'E')), _e -> nullif(_e, $2))",
    ("map_extract", 2): "array(try_element_at($0, $1))",
    ("date_bin", 2): "date_bin($0, $1, TIMESTAMP_NTZ '1970-01-01 00:00:00')",
    ("from_unixtime", 1): "CAST(timestamp_seconds($0) AS TIMESTAMP_NTZ)",
    ("to_timestamp_nanos", 1): "timestamp_micros($0 div 1000)",
    ("to_local_time", 1): "CAST($0 AS TIMESTAMP_NTZ)",
    ("to_unixtime", 1): "unix_seconds(CAST($0 AS TIMESTAMP))",
    # Counts that reach before the first character take from it, and negative ones leave off as many.
    ("substr", 2): "substring($0, greatest($1, 1))",
    ("substring", 2): "substring($0, greatest($1, 1))",
    ("substr", 3): "substring($0, greatest($1, 1), greatest($1 + $2 - greatest($1, 1), 0))",
    ("substring", 3): "substring($0, greatest($1, 1), greatest($1 + $2 - greatest($1, 1), 0))",
    ("left", 2): "substring($0, 1, IF($1 < 0, greatest(char_length($0) + $1, 0), $1))",
    ("right", 2): "substring($0, IF($1 < 0, 1 - $1, greatest(char_length($0) - $1 + 1, 1)))",
    ("array_element", 2): "get($0, IF($1 < 0, size($0) + $1, $1 - 1))",
    ("array_extract", 2): "get($0, IF($1 < 0, size($0) + $1, $1 - 1))",
    ("array_ndims", 1): "size(split(typeof($0), 'array<')) - 1",
    ("array_dims", 1): _DIMS,
    ("range", 1): "IF($0 > 0, sequence(0, greatest($0 - 1, 0)), slice(array(0), 1, 0))",
    ("range", 2): "IF($1 > $0, sequence($0, greatest($1 - 1, $0)), slice(array($0), 1, 0))",
    ("range", 3): "IF(($1 - $0) * sign($2) > 0, sequence($0, IF(($1 - $0) * sign($2) > 0, $1 - CAST(sign($2) AS INT), $0), $2), slice(array($0), 1, 0))",
    ("approx_percentile_cont_with_weight", 3): "percentile($0, $2, CAST($1 AS BIGINT))",
    ("approx_percentile_cont_with_weight", 4): "percentile($0, $2, CAST($1 AS BIGINT))",
}

#: Names of arrow types -> Spark's.
ARROW = {
    "int8": "TINYINT", "int16": "SMALLINT", "int32": "INT", "int64": "BIGINT", "uint8": "SMALLINT", "uint16": "INT", "uint32": "BIGINT", "uint64": "DECIMAL(20, 0)",
    "float32": "FLOAT", "float64": "DOUBLE", "utf8": "STRING", "largeutf8": "STRING", "boolean": "BOOLEAN", "date32": "DATE", "binary": "BINARY",
}

#: Letters of strftime -> Java's patterns.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "3f": "SSS", "6f": "SSSSSS", "f": "SSSSSS", "%": "%",
}


def _literal(arg: list[str], of: str) -> str:
    if len(arg) != 1 or arg[0][0] != "'":
        raise QueryError(f"{of} needs a literal text")
    return arg[0][1:-1].replace("''", "'")


def _java(fmt: str) -> str:
    def part(m: re.Match) -> str:
        if not m[1]:
            return "''" + m[0] + "''"
        if m[1] not in STRFTIME:
            raise QueryError(f"unsupported format %{m[1]}")
        return STRFTIME[m[1]]

    return re.sub(r"%(\d?.)|[A-Za-z]+", part, fmt)


def _formatted(spark_name: str) -> Callable:
    def run(args: list[list[str]]) -> str | None:
        if len(args) == 2 and len(args[1]) == 1 and "%" in args[1][0] and args[1][0][0] == "'":
            return f"{spark_name}($0, '{_java(_literal(args[1], spark_name))}')"
        return f"{spark_name}(" + ", ".join(f"${i}" for i in range(len(args))) + ")"

    return run


def _regexp_match(args: list[list[str]]) -> str:
    pattern = _literal(args[1], "regexp_match")
    flags = f"(?{_literal(args[2], 'regexp_match')})" if len(args) > 2 else ""
    groups = len(re.findall(r"(?<!\\)\((?!\?(?!P?<[A-Za-z]))", pattern))
    whole = f"concat('{flags}', $1)"
    found = ", ".join(f"regexp_extract($0, {whole}, {g})" for g in (range(1, groups + 1) if groups else (0,)))
    return f"IF(regexp_like($0, {whole}), array({found}), NULL)"


def _array_sort(args: list[list[str]]) -> str:
    up = _literal(args[1], "array_sort").upper() != "DESC"
    some = _SORTED.format(str(up).lower())
    first = len(args) < 3 or _literal(args[2], "array_sort").upper() == "NULLS FIRST"
    return f"concat({_NULLS}, {some})" if first else f"concat({some}, {_NULLS})"


def _arrow_cast(args: list[list[str]]) -> str:
    name = _literal(args[1], "arrow_cast").lower()
    to = "TIMESTAMP_NTZ" if name.startswith("timestamp(") else ARROW.get(name)
    if not to:
        raise QueryError(f"arrow_cast cannot make {name}")
    return f"CAST($0 AS {to})"


def _get_field(args: list[list[str]]) -> str:
    return f"$0.`{_literal(args[1], 'get_field')}`"


def _references(text: str, shift: int) -> str:
    """A replacement's references to groups, as Java writes them."""
    return re.sub(r"\\(\d)|\$(\d+)|\$\{(\d+)\}", lambda m: "$" + str(int(m[1] or m[2] or m[3]) + shift), text)


def _regexp_replace(args: list[list[str]]) -> str:
    """The first match, or all of them with flag g."""
    flags = _literal(args[3], "regexp_replace") if len(args) > 3 else ""
    if set(flags) - set("gimsx"):
        raise QueryError(f"unsupported flags {flags} of regexp_replace")
    inline = f"(?{flags.replace('g', '')})" if flags.replace("g", "") else ""
    plain = len(args[2]) == 1 and args[2][0][0] == "'"
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    if "g" in flags:
        by = quoted(_references(_literal(args[2], "regexp_replace"), 0)) if plain else "$2"
        return f"regexp_replace($0, concat('{inline}', $1), {_protected(by)})"
    # What stands before the first match is a group of its own, put back.
    by = quoted("$1" + _references(_literal(args[2], "regexp_replace"), 1)) if plain else "concat('$1', $2)"
    return f"regexp_replace($0, concat('{inline}', chr(92), 'A((?s:.*?))(?:', $1, ')'), {_protected(by)})"


def _protected(text: str) -> str:
    """$ and a digit are no place of an argument here."""
    return re.sub(r"'[^']*'", lambda m: m[0].replace("$", "\0"), text)


def _date_part(args: list[list[str]]) -> str:
    part = _literal(args[0], "date_part").lower()
    return DATE_PARTS.get(part, f"date_part('{part}', $1)")


def _extract(args: list[list[str]]) -> str | None:
    if len(args[0]) < 3 or args[0][1].upper() != "FROM":
        return None
    found = DATE_PARTS.get(args[0][0].strip("'").lower())
    if found:
        args[:] = [args[0][:1], args[0][2:]]
    return found


#: Parts that Spark counts otherwise or does not have.
DATE_PARTS = {
    "dow": "dayofweek($1) - 1",
    "epoch": "unix_micros(CAST($1 AS TIMESTAMP)) / CAST(1000000 AS DOUBLE)",
    "millisecond": "CAST(extract(SECOND FROM $1) * 1000 AS DOUBLE)",
    "milliseconds": "CAST(extract(SECOND FROM $1) * 1000 AS DOUBLE)",
    "microsecond": "CAST(extract(SECOND FROM $1) * 1000000 AS DOUBLE)",
    "microseconds": "CAST(extract(SECOND FROM $1) * 1000000 AS DOUBLE)",
}


WRITTEN: dict[tuple[str, int], Callable] = {
    ("regexp_replace", 3): _regexp_replace,
    ("regexp_replace", 4): _regexp_replace,
    ("date_part", 2): _date_part,
    ("datepart", 2): _date_part,
    ("extract", 1): _extract,
    ("to_char", 2): _formatted("date_format"),
    ("date_format", 2): _formatted("date_format"),
    ("to_timestamp", 2): _formatted("to_timestamp"),
    ("to_date", 2): _formatted("to_date"),
    ("regexp_match", 2): _regexp_match,
    ("regexp_match", 3): _regexp_match,
    ("array_sort", 2): _array_sort,
    ("array_sort", 3): _array_sort,
    ("arrow_cast", 2): _arrow_cast,
    ("get_field", 2): _get_field,
}


NAMES = {name for name, _ in (*TEMPLATES, *WRITTEN)}


#: Spark's own names, under which list_x may be known too.
ARRAYS = {"array_append", "array_contains", "array_distinct", "array_except", "array_intersect", "array_join", "array_repeat", "array_union"}


def named(name: str) -> str:
    """list_x is array_x."""
    name = name.lower()
    if name in ("array_indexof", "list_indexof"):
        return "array_position"
    array = "array_" + name.removeprefix("list_")
    return array if name.startswith("list_") and array in NAMES | ARRAYS | RENAMED.keys() else name


def may_expand(name: str) -> bool:
    return named(name) in NAMES


def expand(name: str, args: list[list[str]]) -> list[str] | None:
    """Tokens of the expression for a call, or None where it is left as it is."""
    key = (named(name), len(args))
    template = TEMPLATES.get(key) or (WRITTEN[key](args) if key in WRITTEN else None)
    if template is None:
        return None
    out: list[str] = []
    for part in re.split(r"(\$\d)", template):
        # An operand of several tokens keeps its own precedence.
        if re.fullmatch(r"\$\d", part):
            arg = args[int(part[1])]
            out += arg if len(arg) == 1 else ["(", *arg, ")"]
        else:
            out += [x.replace("\0", "$") for x in _tokens(part)]
    return ["(", *out, ")"]


def _tokens(text: str) -> list[str]:
    """Tokens, with a name in backquotes as one."""
    out: list[str] = []
    for part in re.split(r"(`[^`]*`)", text):
        out += [part] if part[:1] == "`" else tokens(part)
    return out


# ---- aggregates with an ORDER BY of their own ------------------------------

ORDERED = {"array_agg", "string_agg", "first_value", "last_value"}


def _keys(t: list[str]) -> list[tuple[list[str], bool, bool]]:
    """(expression, ascending, nulls first) of each key of an ORDER BY list."""
    out, depth, item = [], 0, []
    for x in [*t, ","]:
        depth += (x in "([") - (x in ")]")
        if x != "," or depth:
            item.append(x)
            continue
        up = [w.upper() for w in item]
        first = None
        if up[-2:-1] == ["NULLS"]:
            first, item, up = up[-1] == "FIRST", item[:-2], up[:-2]
        down = up[-1:] == ["DESC"]
        if up[-1:] in (["DESC"], ["ASC"]):
            item = item[:-1]
        out.append((item, not down, down if first is None else first))
        item = []
    return out


def _listed(value: list[str], keys: list[tuple[list[str], bool, bool]]) -> list[str]:
    """array_agg keeps nulls, and sorts by keys that are gathered with the values."""
    distinct = value[:1] and value[0].upper() == "DISTINCT"
    fields = [*(value[1:] if distinct else value), "AS", "_v"]
    for n, (key, _, _) in enumerate(keys):
        fields += [",", *key, "AS", f"_k{n}"]
    found = ["array_agg", "(", *(["DISTINCT"] if distinct else []), "struct", "(", *fields, ")", ")"]
    if keys:
        cases = []
        for n, (_, up, first) in enumerate(keys):
            a, b = f"_l._k{n}", f"_r._k{n}"
            null, less = (-1, 1) if first else (1, -1), (-1, 1) if up else (1, -1)
            cases.append(f"WHEN {a} IS NULL AND {b} IS NOT NULL THEN {null[0]} WHEN {a} IS NOT NULL AND {b} IS NULL THEN {null[1]} WHEN {a} < {b} THEN {less[0]} WHEN {a} > {b} THEN {less[1]}")
        found = ["array_sort", "(", *found, *tokens(f", (_l, _r) -> CASE {' '.join(cases)} ELSE 0 END"), ")"]
    return ["transform", "(", *found, *tokens(", _s -> _s._v"), ")"]


def ordered(name: str, args: list[str], then: str, rewrite: Callable[[list[str]], list[str]]) -> list[str] | None:
    """Tokens for an aggregate over args, or None where Spark has it as it stands. Before OVER it is left alone."""
    name = name.lower()
    if name not in ORDERED or then.upper() in ("OVER", "FILTER", "IGNORE", "RESPECT", "WITHIN"):
        return None
    depth, at = 0, len(args)
    for i, x in enumerate(args):
        depth += (x in "([") - (x in ")]")
        if not depth and x.upper() == "ORDER":
            at = i
            break
    value, order = args[:at], args[at + 2 :]
    if name == "array_agg":
        return _listed(rewrite(value), [(rewrite(k), up, first) for k, up, first in _keys(order)] if order else [])
    if not order:
        return None
    if name == "string_agg":
        return ["listagg", "(", *rewrite(value), ")", "WITHIN", "GROUP", "(", *rewrite(["ORDER", "BY", *order]), ")"]
    keys = _keys(order)
    if len({(up, first) for _, up, first in keys}) > 1:
        raise QueryError(f"{name} takes keys of one direction")
    _, up, first = keys[0]
    # Nulls sort by a flag before their key: greatest where they come last in ascending order.
    flag = "NOT" if first == up else ""
    parts: list[str] = []
    for key, _, _ in keys:
        parts += [*([","] if parts else []), "(", *rewrite(key), ")", *tokens(f"IS {flag} NULL"), ",", *rewrite(key)]
    by = "min_by" if (name == "first_value") == up else "max_by"
    return [by, "(", *rewrite(value), ",", "struct", "(", *parts, ")", ")"]
