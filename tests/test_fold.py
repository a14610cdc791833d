"""The array fold against a loop over legs: states, outcomes, intervals and level changes, in one batch and in many small ones."""

import random
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest

from flowloom.operators import fold

LEG = ["symbol", "uid", "ts", "prio", "ingest_pos", "leg", "kind", "side", "price", "qty"]


def book_step(state, row):
    """Placed is ignored for an active order; an update replaces; an execution lowers the maker and removes the taker whatever its size."""
    symbol, uid, ts, prio, pos, leg, kind, side, price, qty = row
    outcome = {"cancel": "unknown_cancel", "update": "unknown_update", "maker": "unknown_exec_maker", "taker": "unknown_exec_taker"}.get(kind)
    if kind == "place":
        if state:
            outcome = "duplicate_active_uid"
        else:
            state, outcome = (side or "", price or 0.0, qty if qty is not None else 0, ts, pos), "negative_qty" if qty is not None and qty < 0 else "placed"
    elif state and kind in ("cancel", "taker"):
        state, outcome = None, "removed" if kind == "cancel" else "taken"
    elif state and kind == "update":
        outcome = "negative_qty" if qty is not None and qty < 0 else "updated"
        state = (state[0], state[1] if price is None else price, state[2] if qty is None else qty, *state[3:])
    elif state and kind == "maker":
        left = state[2] if qty is None else max(state[2] - qty, type(qty)(0))
        outcome = "untouched" if qty is None else "reduced" if left else "filled"
        state = (*state[:2], left, *state[3:]) if left or qty is None else None
    return state, [(symbol, uid, ts, prio, pos, leg, kind, outcome, state is not None, *(state or (None,) * 5))]



def level_step(state, row):
    """Signed changes at price levels. A second Placed overwrites and adds again; only makers are reduced, by the whole execution; takers stay."""
    symbol, uid, ts, prio, pos, leg, kind, side, price, qty = row
    out: list[tuple] = []
    atom = lambda p, a, q, i=0: out.append((symbol, ts, prio, pos, leg, i, state[0], p, a, q, uid))
    if kind == "place" and side and price is not None and qty is not None and qty > 0:
        state = (side, price, qty)
        atom(price, "add", qty)
    elif state and kind == "cancel":
        if state[2] > 0:
            atom(state[1], "cancel", state[2])
        state = None
    elif state and kind == "update":
        p, q = state[1] if price is None else price, state[2] if qty is None else qty
        if abs(p - state[1]) > 1e-9:
            if state[2] > 0:
                atom(state[1], "cancel", state[2], 0)
            if q > 0:
                atom(p, "add", q, 1)
        elif abs(q - state[2]) > 1e-12:
            atom(p, "add" if q > state[2] else "cancel", abs(q - state[2]))
        state = (state[0], p, q)
    elif state and kind == "maker" and qty is not None and qty > 0:
        atom(state[1], "exec_reduce", qty)
        left = state[2] - qty
        state = (*state[:2], left) if left > 1e-12 else None
    return state, out


def looped(step, rows):
    """step over the legs of each order; states after each leg."""
    state, of, out, states = None, None, [], []
    for r in rows:
        if r[:2] != of:
            state, of = None, r[:2]
        state, made = step(state, r)
        out += made
        states.append(state)
    return out, states


def legs(seed, qty, orders=12, n=700):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rnd.choices(fold.KINDS, [4, 4, 6, 1, 1])[0]
        side, price = rnd.choice(["buy", "sell", "", None]), rnd.choice([None, 10.0, 10.0, 11.5, 0.0])
        q = qty(rnd)
        rows.append((rnd.choice("XY"), f"u{min(rnd.randrange(orders), rnd.randrange(orders))}", rnd.randrange(80), fold.KINDS.index(kind), i, 0, kind, side if kind == "place" else None, price if kind in ("place", "update") else None, None if kind in ("taker", "cancel") and rnd.random() < 0.5 else q))
    return sorted(rows, key=lambda r: (r[1], r[0], *r[2:6]))


QTY = {
    "double": (lambda r: r.choice([None, 0.0, 0.1, 0.2, 0.3, 0.7, 1.0, 3.0, -1.0]), pa.float64()),
    "decimal": (lambda r: r.choice([None, Decimal("0.00"), Decimal("0.10"), Decimal("0.30"), Decimal("2.00"), Decimal("-1.50")]), pa.decimal128(18, 2)),
    "wide": (lambda r: r.choice([None, Decimal("0.00"), Decimal("0.10"), Decimal("12345678901234567890.10")]), pa.decimal128(30, 2)),
}


def batches(rows, kind, size):
    types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), kind]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], LEG)
    return [whole.slice(i, size) for i in range(0, len(rows), size)]


def ran(rule, out, end, parts):
    return [tuple(r.values()) for b in fold.streamed(rule, out, end)(iter(parts)) for r in b.to_pylist()]


@pytest.mark.parametrize("kind", QTY)
@pytest.mark.parametrize("size", [1, 7, 10_000])
@pytest.mark.parametrize("seed", range(6))
def test_fold_is_the_loop(kind, size, seed):
    make, arrow = QTY[kind]
    rows = legs(seed, make, orders=2 + 3 * seed)
    parts = batches(rows, arrow, size)
    want, states = looped(book_step, rows)
    assert ran(fold.book, fold.transitions, lambda _: None, parts) == want
    spans = []
    for i, (r, s) in enumerate(zip(rows, states)):
        nxt = rows[i + 1][2] if i + 1 < len(rows) and rows[i + 1][:2] == r[:2] else None
        if s and (nxt is None or nxt > r[2]):
            spans.append((r[0], r[1], r[2], nxt, *s))
    assert sorted(ran(fold.book, fold.spans, lambda held: held, parts), key=str) == sorted(spans, key=str)
    want, _ = looped(level_step, rows)
    assert sorted(ran(fold.level, fold.changes, lambda _: None, parts), key=str) == sorted(want, key=str)


def test_long_runs_keep_the_order_of_subtractions():
    """0.3 - 0.1 - 0.1 - 0.1 is not zero in doubles, in a short run and in one of many thousands, alone or among many orders."""
    for orders in (1, 40):
        rows = [("X", f"o{k:02}", 0, 0, 0, 0, "place", "buy", 1.0, 0.3) for k in range(orders)]
        rows += [("X", f"o{k:02}", 1 + i, 2, i, 0, "maker", None, None, 0.1 if i < 3 else 1e-20) for k in range(orders) for i in range(3_000)]
        rows.sort(key=lambda r: r[1:])
        want, _ = looped(book_step, rows)
        assert ran(fold.book, fold.transitions, lambda _: None, batches(rows, pa.float64(), 1_000)) == want


def test_numbers_come_back():
    for kind, values in ((pa.decimal128(18, 2), [Decimal("-1.25"), None, Decimal("99999999999999.99")]), (pa.decimal128(30, 2), [Decimal("1.25"), None]), (pa.float64(), [0.5, None])):
        a = pa.array([values[0], *values], kind).slice(1)
        assert fold.column(*fold.numbers(a), kind).to_pylist() == values
    assert np.array_equal(fold.forward(np.array([1, 3]), 5), [-1, 1, 1, 3, 3])
