"""Rounding that gives the same double in Spark and in the SQL oracle.

``round(x, d)`` differs between engines on exact ties: Spark rounds the
shortest decimal form half-up, DuckDB scales and calls ``std::round``.  An
interpolated percentile half-way between two values with d + 1 decimals is
such a tie.  Scaling first and rounding to an integer is exact in both
(a double equal to k + 0.5 prints as such, anything else is not a tie), so
``round(x * 10^d) / 10^d`` agrees bit for bit.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(col: str | Column, digits: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** digits)
    return F.round(c * F.lit(scale), 0) / F.lit(scale)


_ROUND = re.compile(r"(?<![A-Za-z_])round\(")


def scaled_round_sql(sql: str) -> str:
    """Rewrite every ``round(expr, d)`` of an SQL text as
    ``(round((expr) * 1eD) / 1eD)``; ``round_even`` and one-argument rounds
    are left alone."""
    out, pos = [], 0
    while True:
        m = _ROUND.search(sql, pos)
        if not m:
            out.append(sql[pos:])
            return "".join(out)
        if sql.count("'", 0, m.start()) % 2:      # inside a string literal
            out.append(sql[pos:m.end()])
            pos = m.end()
            continue
        start = m.end()
        depth, i, last_comma = 1, start, None
        quote = None
        while depth:
            ch = sql[i]
            if quote:
                if ch == quote:
                    quote = None
            elif ch in "'\"":
                quote = ch
            elif ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                last_comma = i
            i += 1
        inner_end = i - 1
        if last_comma is None:
            out.append(sql[pos:i])
            pos = i
            continue
        expr = scaled_round_sql(sql[start:last_comma])
        digits = int(sql[last_comma + 1:inner_end].strip())
        out.append(sql[pos:m.start()])
        out.append(f"(round(({expr}) * 1e{digits}::DOUBLE) / 1e{digits}::DOUBLE)")
        pos = i
