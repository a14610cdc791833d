"""Folds over the legs of orders, many orders at once.

A leg is a function of an order's state: a cancel empties it, a place fills an empty one, an update sets what it names, an execution takes max(0, q - x) and empties what
reaches zero. Legs compose by what they leave open. Cancels cut an order's legs into segments that start empty whatever came before; within one, a quantity is
known again at every place and update, and only executions between two of these depend on each other. So a batch is folded by arrays: where each such run would end is
found for all runs together, one execution of each at a time (long runs apart, each in one call); which runs count follows from the places, a life from a place to its
end, the next life from the first place after it; then states are filled forward. Subtractions keep their order, so doubles give what a loop over legs gives;
decimals are whole numbers. The last order of a batch enters the next one as a place with its state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KINDS = ["place", "update", "maker", "taker", "cancel"]
PLACE, UPDATE, MAKER, TAKER, CANCEL = range(5)
FEW = 16


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where null) and where they are known. Decimals of at most 18 digits are whole numbers in units of their last digit, longer ones Python's decimals."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    if pa.types.is_decimal(column.type):
        if column.type.precision > 18:
            zero = pa.scalar(0, pa.int64()).cast(column.type)
            return np.array(column.fill_null(zero).to_pylist(), object), known
        low = np.frombuffer(column.buffers()[1], np.int64)[::2][column.offset : column.offset + len(column)]
        return np.where(known, low, 0), known
    return column.fill_null(0).to_numpy(zero_copy_only=False), known


def column(values: np.ndarray, known: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The inverse of numbers()."""
    if pa.types.is_decimal(kind) and values.dtype != object:
        wide = np.empty((len(values), 2), np.int64)
        wide[:, 0], wide[:, 1] = values, values >> 63
        bits = pa.array(known).buffers()[1]
        return pa.Array.from_buffers(kind, len(values), [bits, pa.py_buffer(wide.tobytes())])
    return pa.array(values, kind, mask=~known)


def runs(start: np.ndarray, value: np.ndarray, stop: np.ndarray, makers: np.ndarray, x: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Each run's value less the executions (places makers, quantities x) between start and stop, one after the other until it is at most floor: where that is (-1: nowhere), and what each execution leaves."""
    at, end = np.searchsorted(makers, start, "right"), np.searchsorted(makers, stop, "left")
    dead, left, value = np.full(len(start), -1), np.zeros(len(makers), x.dtype), value.copy()
    live = np.flatnonzero(at < end)
    while len(live) >= FEW:
        now = at[live]
        rest = value[live] - x[now]
        value[live] = left[now] = rest
        out = (rest <= floor).astype(bool)
        dead[live[out]] = makers[now[out]]
        at[live] += 1
        live = live[~out]
        live = live[at[live] < end[live]]
    for i in live:
        rest = np.subtract.accumulate(np.concatenate([value[i : i + 1], x[at[i] : end[i]]]))[1:]
        out = (rest <= floor).astype(bool)
        n = int(np.argmax(out)) + 1 if out.any() else len(out)
        left[at[i] : at[i] + n] = rest[:n]
        if out.any():
            dead[i] = makers[at[i] + n - 1]
    return dead, left


def forward(at: np.ndarray, n: int) -> np.ndarray:
    """The last of the places `at` at or before each of n rows, -1 before the first."""
    mark = np.full(n, -1)
    mark[at] = at
    return np.maximum.accumulate(mark)


def fold(kind: np.ndarray, first: np.ndarray, qty: np.ndarray, known: np.ndarray, price: np.ndarray, priced: np.ndarray, place: np.ndarray, again: bool, cut: np.ndarray, makers: np.ndarray, floor: float) -> SimpleNamespace:
    """States of orders over legs. first: an order's first leg; place: legs that place; again: a place replaces an active order; cut: legs that end an order; makers: places of legs that execute.

    life: the place that a leg's order lives from; before, after: whether it is active before and after the leg; qty, price: after it.
    """
    n = len(kind)
    idx = np.arange(n)
    new = first.copy()
    new[1:] |= cut[:-1]
    if again:
        new |= place
    seg = np.cumsum(new) - 1
    ends = np.append(np.flatnonzero(new)[1:], n)[seg]
    p, u = np.flatnonzero(place), np.flatnonzero((kind == UPDATE) & known)
    x = qty[makers]
    following = lambda i: np.minimum(np.append(u, n)[np.searchsorted(u, i, "right")], ends[i])
    start = np.concatenate([p, u])
    dead, left = runs(start, qty[start], following(start), makers, x, floor)

    # an update's run that ends nowhere goes on with the next update's
    of_u, ending = dead[len(p) :], np.flatnonzero(dead[len(p) :] >= 0)
    later = np.append(ending, len(u))

    def drained(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Where an order that is active at legs i ends by execution, updates from the j-th on; n: nowhere."""
        k = later[np.searchsorted(ending, j, "left")]
        hit = k < len(u)
        hit[hit] = seg[u[k[hit]]] == seg[i[hit]]
        out = np.full(len(i), n)
        out[hit] = of_u[k[hit]]
        return out

    death = np.where(dead[: len(p)] >= 0, dead[: len(p)], drained(p, np.searchsorted(u, p, "right")))
    alive = np.zeros(len(p), bool)
    now = np.flatnonzero(np.append(True, seg[p[1:]] != seg[p[:-1]])[: len(p)])
    while len(now):
        alive[now] = True
        after = np.searchsorted(p, death[now], "right")
        on = (death[now] < n) & (after < len(p))
        on[on] = seg[p[after[on]]] == seg[p[now[on]]]
        now = after[on]

    begun = p[alive]
    life = forward(begun, n)
    within = life >= 0
    within[within] = seg[life[within]] == seg[within]
    end = np.full(n, n)
    end[begun] = death[alive]
    end = end[life]
    before, after = within & (life < idx) & (idx <= end), within & (idx < end) & ~cut
    sets = u[before[u]]
    if len(begun) + len(sets) < len(start):
        start = np.concatenate([begun, sets])
        _, left = runs(start, qty[start], following(start), makers, x, floor)
    value = qty.copy()
    value[makers] = left
    hit = before[makers]
    last = forward(np.concatenate([begun, sets, makers[hit]]), n)
    moved = forward(np.concatenate([begun, np.flatnonzero(before & (kind == UPDATE) & priced)]), n)
    return SimpleNamespace(life=life, before=before, after=after, qty=value[last], price=price[moved])


class Batch:
    """A batch of legs as arrays, with the carried order's state as its first row (held = 1) if there is one."""

    def __init__(self, rows: pa.RecordBatch, held: pa.RecordBatch | None) -> None:
        table = pa.Table.from_batches([rows] if held is None else [held, rows]).combine_chunks()
        self.rows = {n: c.chunk(0) for n, c in zip(table.column_names, table.columns)}
        self.held, self.schema, n = int(held is not None), rows.schema, len(table)
        uid, symbol = self.rows["uid"], self.rows["symbol"]
        differs = lambda c: pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True).to_numpy(zero_copy_only=False) & ~(pc.and_(c.slice(1).is_null(), c.slice(0, n - 1).is_null()).to_numpy(zero_copy_only=False))
        self.first = np.append(True, differs(uid) | differs(symbol))
        self.kind = pc.index_in(self.rows["kind"], pa.array(KINDS)).to_numpy(zero_copy_only=False)
        self.ts = self.rows["ts"].to_numpy()
        (self.qty, self.known), (self.price, self.priced) = numbers(self.rows["qty"]), numbers(self.rows["price"])
        self.more, self.less = ((self.known & op(self.qty, 0).astype(bool)) for op in (np.greater, np.less))

    def taken(self, name: str, at: np.ndarray, known: np.ndarray) -> pa.Array:
        return self.rows[name].take(pa.array(at, mask=~known))

    def state(self, f: SimpleNamespace) -> pa.RecordBatch | None:
        """The last order as a place with its state, if it is active."""
        n, at = len(self.ts), f.life[-1]
        if not f.after[-1]:
            return None
        one = {c: a.slice(at, 1) for c, a in self.rows.items()}
        yes = np.ones(1, bool)
        one |= {"kind": pa.array(["place"]), "qty": column(f.qty[n - 1 :], yes, self.rows["qty"].type), "price": column(f.price[n - 1 :], yes, self.rows["price"].type)}
        return pa.RecordBatch.from_arrays(list(one.values()), schema=self.schema)


def book(b: Batch) -> SimpleNamespace:
    """Placed is ignored for an active order; an update replaces; an execution lowers the maker and removes the taker whatever its size."""
    makers = np.flatnonzero((b.kind == MAKER) & b.known)
    cut = (b.kind == CANCEL) | (b.kind == TAKER)
    return fold(b.kind, b.first, b.qty, b.known, b.price, b.priced, b.kind == PLACE, False, cut, makers, 0)


def level(b: Batch) -> SimpleNamespace:
    """A second Placed replaces the first; one without side, price or quantity does nothing; only makers are lowered, and takers stay."""
    side = pc.fill_null(pc.not_equal(b.rows["side"], ""), False).to_numpy(zero_copy_only=False)
    place = (b.kind == PLACE) & side & b.priced & b.more
    place[: b.held] = True
    makers = np.flatnonzero((b.kind == MAKER) & b.more)
    return fold(b.kind, b.first, b.qty, b.known, b.price, b.priced, place, True, b.kind == CANCEL, makers, 1e-12 if b.qty.dtype == float else 0)


def streamed(rule: Callable[[Batch], SimpleNamespace], out: Callable[[Batch, SimpleNamespace, object], tuple[pa.RecordBatch, object]], end: Callable[[object], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted legs -> out's rows for each batch. out gives what it still holds of the last order, which it gets again with the next batch, or end with the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_, of = None, None, None
        for rows in batches:
            if not len(rows):
                continue
            if (rows["symbol"][0].as_py(), rows["uid"][0].as_py()) != of:
                if open_ is not None:
                    yield end(open_)
                held = open_ = None
            b = Batch(rows, held)
            f = rule(b)
            made, open_ = out(b, f, open_)
            held, of = b.state(f), (rows["symbol"][-1].as_py(), rows["uid"][-1].as_py())
            yield made
        if open_ is not None:
            yield end(open_)

    return run


OUTCOMES = ["placed", "negative_qty", "duplicate_active_uid", "updated", "unknown_update", "untouched", "reduced", "filled", "unknown_exec_maker", "taken", "unknown_exec_taker", "removed", "unknown_cancel"]


def transitions(b: Batch, f: SimpleNamespace, _: object) -> tuple[pa.RecordBatch, None]:
    """A row per leg: outcome and state after it."""
    k, n = b.kind, len(b.kind)
    low = b.less.astype(int)
    of = {
        PLACE: np.where(f.life == np.arange(n), low, 2), UPDATE: np.where(f.before, np.where(low == 1, 1, 3), 4),
        MAKER: np.where(f.before, np.where(b.known, np.where(f.after, 6, 7), 5), 8), TAKER: np.where(f.before, 9, 10), CANCEL: np.where(f.before, 11, 12),
    }
    outcome = pa.array(OUTCOMES).take(pa.array(np.select([k == x for x in of], list(of.values()))))
    state = [pc.if_else(pa.array(f.after), pc.fill_null(b.taken("side", f.life, f.after), ""), None), column(f.price, f.after, b.rows["price"].type), column(f.qty, f.after, b.rows["qty"].type), b.taken("ts", f.life, f.after), b.taken("ingest_pos", f.life, f.after)]
    names = ["symbol", "uid", "ts", "prio", "ingest_pos", "leg", "kind"]
    arrays = [*[b.rows[c] for c in names], outcome, pa.array(f.after), *state]
    return pa.RecordBatch.from_arrays(arrays, [*names, "outcome", "active", "side", "price", "qty", "placed_ms", "placed_pos"]).slice(b.held), None


def spans(b: Batch, f: SimpleNamespace, open_: pa.RecordBatch | None) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
    """The state after a leg until the next leg of its order, where that is later; the last leg's is held, its end unknown. A carried state started where the batch before had it."""
    n = len(b.ts)
    start = b.ts.copy()
    if b.held:
        start[0] = open_["from_ts"][0].as_py()
    last = np.append(b.first[1:], True)
    until = np.append(b.ts[1:], 0)
    at = np.flatnonzero(f.after & (last | (until > start)))
    life, yes = f.life[at], np.ones(len(at), bool)
    arrays = [b.rows["symbol"].take(at), b.rows["uid"].take(at), pa.array(start[at]), pa.array(until[at], mask=last[at]), pc.fill_null(b.rows["side"].take(life), ""), column(f.price[at], yes, b.rows["price"].type), column(f.qty[at], yes, b.rows["qty"].type), b.rows["ts"].take(life), b.rows["ingest_pos"].take(life)]
    made = pa.RecordBatch.from_arrays(arrays, ["symbol", "uid", "from_ts", "to_ts", "side", "price", "qty", "placed_ms", "placed_pos"])
    keep = len(at) - int(len(at) > 0 and at[-1] == n - 1)
    return made.slice(0, keep), made.slice(keep) if keep < len(at) else None


def changes(b: Batch, f: SimpleNamespace, _: object) -> tuple[pa.RecordBatch, None]:
    """Signed changes at price levels, up to two per leg: what leaves a level, then what enters one."""
    n, kind = len(b.kind), b.kind
    unit = 1e-12 if b.qty.dtype == float else 0
    old = np.maximum(np.arange(n) - 1, 0)
    p0, q0 = f.price[old], f.qty[old]
    placed = f.life == np.arange(n)
    placed[: b.held] = False
    p = np.where((kind == UPDATE) & b.priced, b.price, p0)
    q = np.where((kind == UPDATE) & b.known, b.qty, q0)
    update = (kind == UPDATE) & f.before
    away = update & (np.abs(p - p0) > 1e-9)
    resized = update & ~away & (np.abs(q - q0) > unit).astype(bool)
    gone = ((kind == CANCEL) & f.before | away) & (q0 > 0).astype(bool)
    hit = (kind == MAKER) & f.before & b.more
    q = np.where(placed | hit, b.qty, q)
    parts = [
        (placed, 0, b.price, 0, q), (gone, 0, p0, 1, q0), (away & (q > 0).astype(bool), 1, p, 0, q),
        (resized, 0, p, np.where((q > q0).astype(bool), 0, 1), np.abs(q - q0)), (hit, 0, p0, 2, q),
    ]
    at = np.concatenate([np.flatnonzero(m) for m, *_ in parts])
    pick = lambda i: np.concatenate([np.broadcast_to(x[i], n)[x[0]] for x in parts])
    yes = np.ones(len(at), bool)
    arrays = [b.rows[c].take(at) for c in ("symbol", "ts", "prio", "ingest_pos", "leg")]
    arrays += [pa.array(pick(1).astype(np.int32)), b.rows["side"].take(f.life[at]), column(pick(2), yes, b.rows["price"].type), pa.array(["add", "cancel", "exec_reduce"]).take(pick(3)), column(pick(4), yes, b.rows["qty"].type), b.rows["uid"].take(at)]
    return pa.RecordBatch.from_arrays(arrays, ["symbol", "ts", "prio", "ingest_pos", "leg", "emit", "side", "price", "action", "qty", "order_uid"]), None
