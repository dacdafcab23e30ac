"""Transitions of keyed state: a key's state and one event in, its new state and what is told out.

Used by the sorted folds on tables and by the stream operators, so both give the same results.
Times are seconds. States are tuples of plain numbers and strings, None where a key is new.
"""

from __future__ import annotations

import math

#: Slack for a token that rounding keeps just under one.
SLACK = 1e-9


def bucket(state: tuple | None, at: float, limit: int, window: float) -> tuple[tuple, tuple[bool, int, int]]:
    """Token bucket (level, time of the level): `limit` tokens flow in per `window`, as many fit, and an
    event takes one. Tells whether there was one, whole tokens left, and seconds until there is one."""
    flow = limit / window
    level = float(limit) if state is None else min(limit, state[0] + flow * max(0.0, at - state[1]))
    if level < 1 - SLACK:
        return (level, at), (False, int(level), max(1, math.ceil((1 - level) / flow)))
    left = max(0.0, level - 1)
    return (left, at), (True, int(left), 0)


def claim(state: tuple | None, at: float, ttl: float) -> tuple[tuple, bool]:
    """A key is claimed for `ttl` seconds by the first event after the last claim is over."""
    if state is not None and state[0] > at:
        return state, False
    return (at + ttl,), True


def breaker(state: tuple | None, at: float, ok: bool, threshold: int, cooldown: float) -> tuple[tuple, str]:
    """Circuit breaker (failures in a row, since when it is open, or -1). Tells its state before the event;
    while open, events don't count; half open, one failure opens it again and one success closes it."""
    failures, opened = state or (0, -1.0)
    now = "closed" if opened < 0 else "half_open" if at >= opened + cooldown else "open"
    if now == "open":
        return (failures, opened), now
    if ok:
        return (0, -1.0), now
    failures += 1
    return (failures, at if failures >= threshold or now == "half_open" else -1.0), now


def cooldown(state: tuple | None, at: float, url: str, url_ttl: int, host_ttl: int) -> tuple[tuple, tuple[str | None, int]]:
    """Spacing of a host's requests: (the host's block until, address=until of each blocked address). A request is
    refused for its own address first, then for its host, and a refusal for the host leaves the address free.
    Tells the refusal's code, or None, and the seconds to wait."""
    host_until, urls = state or (0.0, ())
    live = tuple((u, t) for u, t in urls if t > at)
    known = dict(live)
    if url_ttl > 0 and url in known:
        return (host_until, live), ("DUPLICATE_REQUEST", max(1, math.ceil(known[url] - at)))
    if host_ttl > 0 and host_until > at:
        return (host_until, live), ("RATE_LIMITED", max(1, math.ceil(host_until - at)))
    if url_ttl > 0:
        live = (*live, (url, at + url_ttl))
    return (at + host_ttl if host_ttl > 0 else host_until, live), (None, 0)


def promotion(state: tuple | None, at: float, seen: bool, price: float | None, expires: float | None, same_item: bool = True) -> tuple[tuple, list[str]]:
    """A listing's promotion (status, price, expiry) after an observation; without one only the clock counts, and
    one of another item counts for nothing. Tells the events that it brings."""
    status, old_price, old_expires = state or (None, None, None)
    if not seen:
        if status == "active" and old_expires is not None and old_expires <= at:
            return ("expired", old_price, old_expires), ["promotion_expired"]
        return (status, old_price, old_expires), []
    if not same_item:
        return (status, old_price, old_expires), []
    now = "expired" if expires is not None and expires <= at else "active"
    events = []
    if status != "active" and now == "active":
        events.append("promotion_activated")
    if status == "active" and now == "expired":
        events.append("promotion_expired")
    elif status == "active" and now == "active" and expires is not None and expires != old_expires:
        events.append("promotion_updated")
    return (now, price, expires), events
