"""Balance against brute force, on a small fixture and over the whole relation of its query."""

from small import SMALL

from cairn.operators import allocation
from cairn.plans import keys
from cairn.plans.relations import relation

EDGE = 64


def code(x, y, z):
    return sum((c >> i & 1) << 3 * i + k for i in range(6) for k, c in enumerate((x, y, z)))


def snapped(d, *p):
    return (d, *[c - c % (EDGE >> d) for c in p])


def balanced(leaves):
    """Closure of octants (depth, x, y, z): all ancestors, and the face neighbours of each octant's parent."""
    out, ask = set(), list(leaves)
    while ask:
        o = ask.pop()
        if o in out:
            continue
        out.add(o)
        d, *p = o
        if d > 0:
            up = snapped(d - 1, *p)
            ask.append(up)
            for k in range(3):
                for step in (-1, 1):
                    q = list(up[1:])
                    q[k] += step * (EDGE >> d - 1)
                    if 0 <= q[k] < EDGE:
                        ask.append((d - 1, *q))
    return {code(*p) + d for d, *p in out}


def test_balance_of_a_fixture(spark):
    leaves = {snapped(3, 8, 8, 8), snapped(3, 40, 0, 56), snapped(2, 48, 48, 0), snapped(1, 0, 32, 32)}
    got = allocation.balance(spark.createDataFrame([(code(*p) + d,) for d, *p in leaves], "key long"), keys.DEPTH)
    assert sorted(r["key"] for r in got.collect()) == sorted(balanced(leaves))


def test_balance_query_takes_all_points(spark):
    points = [r[:] for r in relation(spark, SMALL, "points").select("x", "y", "z").collect()]
    n = {}
    for p in points:
        b = snapped(3, *p)
        n[b] = n.get(b, 0) + 1
    mean = len(points) / len(n)
    leaves = {b if k >= mean else snapped(1, *b[1:]) for b, k in n.items()}
    got = {r["key"] for r in keys.balance(spark, SMALL).collect()}
    assert got == balanced(leaves)
    assert all(code(*snapped(1, *p)[1:]) + 1 in got for p in points)
    assert len(got) > len({snapped(d, *b[1:]) for b in leaves for d in range(b[0] + 1)})  # something is added
