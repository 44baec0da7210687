"""The points-to call graph: a case for each category of calls, with edges worked out by hand."""

import pytest

from factweave.operators import pointcalls
from factweave.sources import flows

#: name: ({path: source}, edges from callers to callees).
CASES = {
    "args": ({"main.py": "def run(f):\n    f()\ndef one():\n    pass\ng = one\nrun(g)\n"}, {"main": ["main.run"], "main.run": ["main.one"]}),
    "args_imported": ({"main.py": "from lib import pick\ndef run(f):\n    f()\nrun(pick)\n", "lib.py": "def pick():\n    pass\n"}, {"main": ["main.run"], "main.run": ["lib.pick"]}),
    "assign_chain": ({"main.py": "def a():\n    pass\nx = y = a\nx()\ny()\n"}, {"main": ["main.a"]}),
    "assign_tuple": ({"main.py": "def a():\n    pass\ndef b():\n    a()\nx, (y, z) = a, (b, a)\ny()\n"}, {"main": ["main.b"], "main.b": ["main.a"]}),
    "assign_star": ({"main.py": "def a(): pass\ndef b(): pass\ndef c(): pass\nx, *y = a, b, c\ny[1]()\n"}, {"main": ["main.c"]}),
    "builtins": ({"main.py": "def f(x):\n    return g\ndef g():\n    pass\nfor r in map(f, [1]):\n    r()\n'a'.upper()\n{}.keys()\n"}, {"main": ["<builtin>.map", "main.f", "main.g", "<**PyStr**>.upper", "<**PyDict**>.keys"]}),
    "class_self": ({"main.py": "class A:\n    def __init__(self, f):\n        self.f = f\n    def go(self):\n        self.f()\n        self.stop()\n    def stop(self):\n        pass\ndef h():\n    pass\na = A(h)\na.go()\n"}, {"main": ["main.A.__init__", "main.A.go"], "main.A.go": ["main.h", "main.A.stop"]}),
    "class_nested_imported": ({"main.py": "import lib\nlib.Out.In().go()\n", "lib.py": "class Out:\n    class In:\n        def go(self):\n            pass\n"}, {"main": ["lib.Out.In.go"]}),
    "class_static": ({"main.py": "class A:\n    @staticmethod\n    def s(f):\n        f()\n    @classmethod\n    def c(cls, f):\n        cls.s(f)\ndef h(): pass\nA.c(h)\n"}, {"main": ["main.A.c"], "main.A.c": ["main.A.s"], "main.A.s": ["main.h"]}),
    "class_base_calls_child": ({"main.py": "class A:\n    def go(self):\n        self.step()\nclass B(A):\n    def step(self):\n        pass\nclass C(A):\n    def step(self):\n        pass\nB().go()\n"}, {"main": ["main.A.go"], "main.A.go": ["main.B.step"]}),
    "names_are_no_methods": ({"main.py": "class A:\n    def go(self):\n        pass\ndef run():\n    go()\ndef go():\n    pass\nrun()\n"}, {"main": ["main.run"], "main.run": ["main.go"]}),
    "decorators": ({"main.py": "def d(f):\n    def inner():\n        f()\n    return inner\ndef e(f):\n    return f\n@d\n@e\ndef g():\n    pass\ng()\n"}, {"main": ["main.d", "main.e", "main.d.inner"], "main.d.inner": ["main.g"]}),
    "dicts": ({"main.py": "from keys import k\ndef a(): pass\ndef b(): pass\ndef c(): pass\nd = {'x': a, 'y': b}\nd[k]()\ne = {}\ne.update({'z': c})\ne['z']()\n", "keys.py": "k = 'y'\n"}, {"main": ["main.b", "<**PyDict**>.update", "main.c"]}),
    "direct": ({"main.py": "def a():\n    return b\ndef b():\n    pass\na()()\n"}, {"main": ["main.a", "main.b"]}),
    "dynamic": ({"main.py": "eval('f()')\n"}, {"main": ["<builtin>.eval"]}),
    "exceptions": ({"main.py": "class E(Exception):\n    def __init__(self):\n        pass\ndef f():\n    raise E\nf()\n"}, {"main": ["main.f"], "main.f": ["main.E.__init__"]}),
    "external": ({"main.py": "import ext\nfrom ext import g as h\nx = ext.Cls()\nx.run()\nh()\nclass A(ext.Base):\n    def f(self):\n        self.up()\nA().f()\n"}, {"main": ["ext.Cls", "ext.Cls.run", "ext.g", "ext.Base.__init__", "main.A.f"], "main.A.f": ["ext.Base.up"]}),
    "generators": ({"main.py": "def a(): pass\ndef gen():\n    yield a\nfor f in gen():\n    f()\nclass It:\n    def __iter__(self):\n        return self\n    def __next__(self):\n        return b\ndef b(): pass\nfor f in It():\n    f()\n"}, {"main": ["main.gen", "main.a", "main.It.__iter__", "main.It.__next__", "main.b"]}),
    "imports": ({"main.py": "import pkg.sub\nfrom pkg import *\nfrom pkg.sub import g as h\npkg.sub.g()\nf()\nh()\n", "pkg/__init__.py": "from .sub import g\ndef f():\n    g()\n", "pkg/sub.py": "from . import f\ndef g():\n    pass\n"}, {"main": ["pkg.sub.g", "pkg.f"], "pkg.f": ["pkg.sub.g"]}),
    "kwargs": ({"main.py": "def run(a, *rest, f=None):\n    f()\n    rest[0]()\ndef one(): pass\ndef two(): pass\nrun(1, two, f=one)\n"}, {"main": ["main.run"], "main.run": ["main.one", "main.two"]}),
    "lambdas": ({"main.py": "def a(): pass\nf = lambda g: g()\nf(a)\n(lambda: a)()()\n"}, {"main": ["main.<lambda1>", "main.<lambda2>", "main.a"], "main.<lambda1>": ["main.a"]}),
    "lists": ({"main.py": "def a(): pass\ndef b(): pass\ndef c(): pass\nl = [a, b, c]\nl[1:][0]()\nm = [f() for f in [c]]\n"}, {"main": ["main.b", "main.c"]}),
    "mro": ({"main.py": "class A:\n    def f(self): pass\nclass B(A):\n    def f(self):\n        super().f()\nclass C(A):\n    def f(self):\n        super().f()\nclass D(B, C):\n    pass\nD().f()\n"}, {"main": ["main.B.f"], "main.B.f": ["<builtin>.super", "main.C.f"], "main.C.f": ["<builtin>.super", "main.A.f"]}),
    "returns": ({"main.py": "def a():\n    return b\ndef b():\n    return c() if a else c\ndef c():\n    return 1\na()()()\n"}, {"main": ["main.a", "main.b", "main.c"], "main.b": ["main.c"]}),
    "recursion_ends": ({"main.py": "import ext\nx = ext\nwhile x:\n    x = x.next\ndef f():\n    return f()\nf()\n"}, {"main": ["main.f"], "main.f": ["main.f"]}),
    "broken": ({"main.py": "def f(:\n"}, {}),
    "empty": ({"main.py": ""}, {}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, path, text) for name, (sources, _) in CASES.items() for path, text in sources.items()]
    rows += [("null", None, None)]
    edges = pointcalls.call_graph(flows.flow_facts(spark.createDataFrame(rows, "project string, path string, text string")))
    out = {}
    for r in edges.collect():
        out.setdefault(r.project, {}).setdefault(r.caller, set()).add(r.callee)
    return out


@pytest.mark.parametrize("name", CASES)
def test_edges(found, name):
    assert found.get(name, {}) == {k: set(v) for k, v in CASES[name][1].items()}


def test_method_order():
    assert pointcalls._c3("D", [["B", "A"], ["C", "A"]], ["B", "C"]) == ["D", "B", "C", "A"]
    assert pointcalls._c3("X", [["A", "B"], ["B", "A"]], ["A", "B"]) == ["X", "A", "B"]  # no order fits
