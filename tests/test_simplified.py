"""Sources that folding and dead-store removal must keep as they are, or valid."""

import ast

import pytest

from factweave.operators.lowering import simplified

CASES = [
    ("class C:\n    if 0:\n        x = 1\n", "class C:\n    pass"),
    ("def f():\n    class A:\n        attr = 1\n    return A\n", "def f():\n\n    class A:\n        attr = 1\n    return A"),
    ("def f():\n    if 0:\n        yield\n    return 1\n", "def f():\n    if 0:\n        yield\n    return 1"),
    ("x = 'a' * 99999999999\ny = 3 * 4\n", "x = 'a' * 99999999999\ny = 12"),
    ("def f():\n    x = 1\n    def g():\n        nonlocal x\n        x = 2\n    return g\n", "def f():\n    x = 1\n\n    def g():\n        nonlocal x\n        x = 2\n    return g"),
    ("def f(a):\n    x = 1\n    for i in a:\n        x = 2\n", "def f(a):\n    for i in a:\n        pass"),
    ("try:\n    if 0:\n        f()\nexcept E:\n    if 0:\n        g()\n", "try:\n    pass\nexcept E:\n    pass"),
    ("if 1:\n    a()\nelse:\n    b()\n", "a()"),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_simplified(text, want):
    got = simplified(text)
    assert got == want
    ast.parse(got)


def test_overwritten_in_a_block(spark):
    from factweave.operators import flow

    cases = {
        1: ("def f(a):\n    x = 1\n    x = 2\n    return x\n", {"x"}),
        2: ("def f(a):\n    x = 1\n    y = x\n    x = 2\n    return x, y\n", set()),
        3: ("def f(a):\n    x = 1\n    x += 2\n    x = 3\n    return x\n", set()),
        4: ("def f(a):\n    try:\n        x = 1\n        a()\n        x = 2\n    except E:\n        return x\n", set()),
        5: ("def f(a):\n    x = 1\n    if a:\n        x = 2\n    return x\n", set()),
        6: ("def f(a):\n    x = y = 1\n    x = lambda: y\n    y = 2\n    return x\n", {"x"}),
    }
    rows = flow.liveness(spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "file_id long, text string")).collect()
    assert {k: {r["var"] for r in rows if r.file_id == k} for k in cases} == {k: want for k, (_, want) in cases.items()}
