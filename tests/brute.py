"""Row-by-row statements of the stateful rules, used as expected results."""

from collections import defaultdict


def fold(rows, reply_timeout, linger):
    """rows: (key, ts, id, side) -> {id: (role, t0, first_id, reply_ts)}."""
    by_key = defaultdict(list)
    for key, ts, rid, side in rows:
        by_key[key].append((ts, rid, side))
    out = {}
    for items in by_key.values():
        state = None
        for ts, rid, side in sorted(items):
            if state and state["last"] is None and ts - state["t0"] >= reply_timeout:
                state = None
            elif state and state["last"] is not None and ts - state["last"] >= linger:
                state = None
            if state is None:
                state = {"t0": ts, "id": rid, "side": side, "last": None}
                out[rid] = ["created", ts, rid, None]
            elif state["last"] is not None:
                state["last"] = ts
                out[rid] = ["linger", state["t0"], state["id"], None]
            elif side == state["side"]:
                out[rid] = ["dup_request", state["t0"], state["id"], None]
            else:
                state["last"] = ts
                out[rid] = ["replied", state["t0"], state["id"], None]
                out[state["id"]][3] = ts
    return {rid: tuple(v) for rid, v in out.items()}
