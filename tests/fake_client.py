"""A paged API in memory, for tests."""

from millrace.sources.paged import Transient

NODES = [{"number": n, "title": f"t{n}", "createdAt": f"2024-01-{n:02d}T00:00:00Z", "updatedAt": f"2024-02-{n:02d}T00:00:00Z"} for n in range(1, 29)]
calls = {"n": 0}


def fetch(mode, cursor, since, page_size, keys):
    calls["n"] += 1
    if calls["n"] % 3 == 1:
        raise Transient("gateway")
    if mode == "keys":
        return {"nodes": [next((x for x in NODES if x["number"] == k), None) for k in keys], "cursor": None}
    ordered = sorted(NODES, key=lambda x: x["updatedAt" if mode == "since" else "createdAt"], reverse=True)
    at = int(cursor or 0)
    return {"nodes": ordered[at : at + page_size], "cursor": str(at + page_size) if at + page_size < len(ordered) else None, "remaining": 5000}
