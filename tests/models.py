"""Small Python models of the operators, written from their definitions."""

import hashlib
import math
import re
from fractions import Fraction


def draw(row, purpose, seed=42):
    return hashlib.md5(f"{seed}:{purpose}:{row}".encode()).hexdigest()


def boxed(text):
    """Content of the last outermost box in front of the first one that never closes."""
    text = text or ""
    partner, waiting = {}, []
    for i, c in enumerate(text):
        if c == "{":
            waiting.append(i)
        elif c == "}" and waiting:
            partner[waiting.pop()] = i
    openings = [m.end() - 1 for m in re.finditer(r"\\boxed\{", text)]
    limit = min((p for p in openings if p not in partner), default=len(text))
    complete = [p for p in openings if p < limit]
    outermost = [p for p in complete if not any(q < p < partner[q] for q in complete)]
    return text[outermost[-1] + 1 : partner[outermost[-1]]].strip() if outermost else ""


def normalized(text):
    return "".join((text or "").lower().split())


def number(text):
    """Value of an integer, decimal or fraction literal, or None."""
    try:
        top, _, bottom = text.partition("/")
        return Fraction(top.strip()) / Fraction(bottom.strip() or "1")
    except (ValueError, ZeroDivisionError):
        return None


def first_by(rows, key, row):
    kept = {}
    for r in sorted(rows, key=row):
        kept.setdefault(key(r), r)
    return sorted(kept.values(), key=row)


def stratified(rows, batch=32, seed=42):
    """[(row id, label)] -> row ids in batch order."""
    dealt = sorted(rows, key=lambda r: (r[1], draw(r[0], "order", seed), r[0]))
    n = max(1, math.ceil(len(dealt) / batch))
    order = sorted(range(n), key=lambda s: (draw(s, "batch", seed), s))
    return [row for s in order for row, _ in dealt[s::n]]


def proportional(rows, size, seed=42):
    """[(row id, source)] -> ids of the sample."""
    if size >= len(rows):
        return {r for r, _ in rows}
    counts = {}
    for _, s in rows:
        counts[s] = counts.get(s, 0) + 1
    picked = set()
    for source, n in counts.items():
        if source is not None:
            ids = sorted((r for r, s in rows if s == source), key=lambda r: (draw(r, "strata", seed), r))
            picked.update(ids[: min(int(n / len(rows) * size), n)])
    others = sorted((r for r, _ in rows if r not in picked), key=lambda r: (draw(r, "topup", seed), r))
    return picked | set(others[: size - len(picked)])


def capped(rows, cap, seed=42):
    """[(row id, label)] of one split -> row ids in order."""
    if len(rows) <= cap:
        return [r for r, _ in rows]
    counts = {}
    for _, label in rows:
        counts[label] = counts.get(label, 0) + 1
    picked = set()
    for label, n in counts.items():
        ids = sorted((r for r, x in rows if x == label), key=lambda r: (draw(r, "cap", seed), r))
        picked.update(ids[: min(round(n / len(rows) * cap), n)])
    turn = sorted((r for r, _ in rows), key=lambda r: (r not in picked, draw(r, "repair", seed), r))
    return sorted(turn[:cap], key=lambda r: (draw(r, "mix", seed), r))
