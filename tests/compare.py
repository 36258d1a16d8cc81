"""Rows as sorted tuples with columns by name, for comparing two engines."""

import datetime
import decimal
import math


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in (plain(r[i]) for i in order)) for r in rows]
    return sorted(columns), sorted(out, key=repr)
