"""Filters and sort keys as columns, typed when the plan is made: by the field's kind and the operand's."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimweave.functions.glob import matches, regex_of
from claimweave.plans.query import CANONICAL_TIME, Key, Test, Where

NUMERIC = ("height", "content_size")
OWN = ("id", "type", "encoding", "created_at", "dated", "content_size", "height")
RFC3339 = r"\A\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)\z"


def value_of(field: str) -> Column:
    """A field of the claim, null where it is absent: the record's own slots, and the open fields by name."""
    return F.col(field) if field in OWN else F.try_element_at("fields", F.lit(field))


def printed(value: Any) -> str:
    """An operand as text: numbers in their shortest form, with an exponent from 1e21 on and below 1e-4."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        number = float(value)
        if number != number or number in (float("inf"), float("-inf")):
            return "NaN" if number != number else "+Inf" if number > 0 else "-Inf"
        digits, _, power = f"{number!r}".partition("e")
        size = abs(number)
        if number == 0:
            return "-0" if str(number).startswith("-") else "0"
        if 1e-4 <= size < 1e21:
            return str(int(number)) if number == int(number) else digits if not power else f"{number:f}".rstrip("0")
        mantissa, _, exponent = f"{number:.17e}".partition("e")
        for places in range(17):
            if float(f"{number:.{places}e}") == number:
                mantissa, _, exponent = f"{number:.{places}e}".partition("e")
                break
        return f"{mantissa}e{exponent[0]}{exponent[1:].zfill(2)}"
    return str(value)


def nanoseconds(text: Column) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 text, null for other texts. Timestamps hold microseconds, so the fraction is added apart."""
    valid = text.rlike(RFC3339)
    whole = F.regexp_replace(text, r"\.\d+", "")
    fraction = F.rpad(F.substring(F.regexp_extract(text, r"\.(\d+)", 1), 1, 9), 9, "0").cast("long")
    return F.when(valid, F.unix_seconds(F.try_to_timestamp(whole)) * F.lit(1_000_000_000).cast("long") + fraction)


def by_instant(text: Column) -> Column:
    """A text to sort by: an RFC 3339 text stands as the same instant in UTC with nine digits, so that instants order whatever their zones; other texts as they are."""
    at = nanoseconds(text)
    part = F.pmod(at, F.lit(1_000_000_000).cast("long"))
    second = ((at - part) / 1_000_000_000).cast("long")
    clock = F.pmod(second, F.lit(86_400).cast("long"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), ((second - clock) / 86_400).cast("int")).cast("string")
    unit = lambda k, n: F.pmod(F.floor(clock / k), F.lit(n).cast("long"))
    return F.coalesce(F.concat(day, F.format_string("T%02d:%02d:%02d.%09dZ", unit(3600, 24), unit(60, 60), unit(1, 60), part)), text)


def _order(op: str, a: Column, b: Column) -> Column:
    return {"eq": a == b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op]


def _compare(field: str, op: str, operand: Any) -> Column:
    value, number = value_of(field), isinstance(operand, (int, float)) and not isinstance(operand, bool)
    if field in NUMERIC:
        if number:
            return _order(op, value.cast("double"), F.lit(float(operand)))
        return value.cast("string") == F.lit(printed(operand)) if op == "eq" else F.lit(False)
    if not isinstance(operand, str):  # strings never order against numbers; they may print alike
        return value == F.lit(printed(operand)) if op == "eq" else F.lit(False)
    if field == "created_at" and CANONICAL_TIME.fullmatch(operand):
        return _order(op, value, F.lit(operand))  # one width, one zone: text order is time order
    plain = _order(op, value, F.lit(operand))
    if re.match(RFC3339.replace(r"\z", r"\Z"), operand):
        ours = nanoseconds(value)
        return F.when(ours.isNotNull(), _order(op, ours, nanoseconds(F.lit(operand)))).otherwise(plain)
    return plain


def test(field: str, t: Test) -> Column:
    value = value_of(field)
    if t.op == "glob":
        out = matches(value.cast("string"), t.value if isinstance(t.value, str) else printed(t.value))
    elif t.op == "in":
        out = reduce(lambda a, b: a | b, (_compare(field, "eq", x) for x in t.value), F.lit(False))
    elif t.op == "ne":
        out = value.isNotNull() & ~_compare(field, "eq", t.value)
    else:
        out = _compare(field, t.op, t.value)
    return F.coalesce(out, F.lit(False))  # an absent field fails every test, and `not` has two values


def filter_of(w: Where | None) -> Column:
    if w is None:
        return F.lit(True)
    if w.all:
        return reduce(lambda a, b: a & b, map(filter_of, w.all))
    if w.any:
        return reduce(lambda a, b: a | b, map(filter_of, w.any))
    return ~filter_of(w.no) if w.no is not None else test(w.field, w.test)


def may_hold(w: Where | None, type_: str) -> bool | None:
    """Whether a filter holds for claims of a type: None where that depends on the claim."""
    if w is None:
        return True
    parts = [may_hold(x, type_) for x in w.all or w.any]
    if w.all:
        return False if False in parts else None if None in parts else True
    if w.any:
        return True if True in parts else None if None in parts else False
    if w.no is not None:
        inner = may_hold(w.no, type_)
        return None if inner is None else not inner
    t = w.test
    if w.field != "type" or t is None:
        return None
    if t.op == "glob" and isinstance(t.value, str):
        e = regex_of(t.value)
        return e is not None and re.search(e.replace(r"\z", r"\Z"), type_) is not None
    if t.op in ("eq", "ne") and isinstance(t.value, str):
        return (type_ == t.value) == (t.op == "eq")
    if t.op == "in" and all(isinstance(x, str) for x in t.value):
        return type_ in t.value
    return None


def sort_columns(keys: tuple[Key, ...]) -> list[Column]:
    """Absent values last in both directions; ties by creation and id."""
    out = []
    for k in keys:
        value, down = value_of(k.field), k.dir == "desc"
        put = lambda c, down=down: c.desc_nulls_last() if down else c.asc_nulls_last()
        if k.compare == "temporal":
            if k.field in NUMERIC:  # no span: all present values tie
                out.append(F.isnull(value).asc())
                continue
            if k.field == "created_at":
                out.append(put(F.expr("created_at_ns div 1000000")))
                continue
            middle = F.col("dated_mid_ms") if k.field == "dated" else F.floor(nanoseconds(value) / 1_000_000)
            out += [F.isnull(value).asc(), F.isnull(middle).desc() if down else F.isnull(middle).asc(), put(middle)]
        elif k.compare == "lexical" or (k.compare in ("", "numeric") and k.field not in NUMERIC):
            out.append(put(F.col("created_at_ns") if k.field == "created_at" and k.compare != "lexical" else by_instant(value.cast("string")) if not k.compare else value.cast("string")))
        else:
            out.append(put(value))
    return [*out, F.col("created_at_ns").asc(), F.col("id").asc()]
