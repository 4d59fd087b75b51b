"""Scores out of a language model's free-form reply."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
LINE = re.compile(r"^\W*(.+?)\W*[:=]\s*([01](?:\.\d+)?)\W*$")


def _objects(reply: str) -> Iterator[dict]:
    """JSON objects of a reply: all of it, fenced parts, then balanced braces."""
    for text in (reply, *FENCE.findall(reply)):
        try:
            found = json.loads(text)
        except ValueError:
            continue
        if isinstance(found, dict):
            yield found
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", reply):
        try:
            found, _ = decoder.raw_decode(reply, m.start())
        except ValueError:
            continue
        if isinstance(found, dict):
            yield found


def _score(x: object) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and 0 <= x <= 1 else None


def single(reply: str, names: Sequence[str], default: float = 0.5) -> dict[str, float]:
    """A score for each name: from the first usable object, else line by line, else the default."""
    for found in _objects(reply):
        got = {n: s for n in names if (s := _score(found.get(n))) is not None}
        if got:
            return {n: got.get(n, default) for n in names}
    lines = {m[1].strip(): float(m[2]) for line in reply.splitlines() if (m := LINE.match(line.strip())) and float(m[2]) <= 1}
    return {n: lines.get(n, next((s for k, s in lines.items() if k[:30] == n[:30]), default)) for n in names}


def batch(reply: str, targets: Sequence[str], names: Sequence[str], default: float = 0.5) -> dict[str, dict[str, float]]:
    """Scores by target: from an object of objects, else from the lines below a target's heading (its first 50 characters)."""
    for found in _objects(reply):
        if any(isinstance(found.get(t), dict) for t in targets):
            return {t: {n: s if (s := _score((found.get(t) or {}).get(n))) is not None else default for n in names} for t in targets}
    out, now = {t: dict.fromkeys(names, default) for t in targets}, None
    for line in map(str.strip, reply.splitlines()):
        if head := next((t for t in targets if t[:50] in line and not LINE.match(line)), None):
            now = head
        elif now and (m := LINE.match(line)) and (n := next((n for n in names if n[:30] == m[1].strip()[:30]), None)):
            out[now][n] = float(m[2])
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.DoubleType()))
def parsed_scores(reply: pd.Series, names: pd.Series) -> pd.Series:
    """single() over columns (reply, array of names)."""
    return pd.Series([single(r or "", list(n)) for r, n in zip(reply, names, strict=True)])
