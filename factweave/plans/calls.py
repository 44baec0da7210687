"""The points-to call graph over programs that order lines describe."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pointcalls
from .base import query, table


def programs(spark, sf_dir):
    """(project, path, text): an order's lines as classes, each one's base the one before; returned ones define a method, and finished ones of these go on to the method above."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_returnflag") != "N").alias("own"), F.max(F.col("l_linestatus") == "F").alias("up"))
    listed = lines.groupBy(F.col("l_orderkey").alias("project")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("k"), "own", "up"))).alias("l"))
    classes = F.expr("""array_join(transform(l, (x, i) -> concat('class L', x.k, if(i = 0, '', concat('(L', l[i - 1].k, ')')), ':\\n',
      if(x.own, concat('    def run(self):\\n        ', if(x.up, 'super().run()', 'pass'), '\\n'), '    pass\\n'))), '')""")
    main = F.expr("concat('import lib\\n', array_join(transform(l, x -> concat('lib.L', x.k, '().run()\\n')), ''))")
    files = F.explode(F.map_from_arrays(F.array(F.lit("lib.py"), F.lit("main.py")), F.array(classes, main))).alias("path", "text")
    return listed.select("project", files)


@query("cgr02", """
WITH l AS (SELECT l_orderkey AS p, l_linenumber AS k, max(l_returnflag <> 'N') AS own, max(l_linestatus = 'F') AS up FROM lineitem GROUP BY ALL),
d AS (SELECT *, max(CASE WHEN own THEN k END) OVER (PARTITION BY p ORDER BY k) AS hit, max(CASE WHEN own THEN k END) OVER (PARTITION BY p ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM l)
SELECT DISTINCT CAST(p AS VARCHAR) AS project, 'main' AS caller, 'lib.L' || hit || '.run' AS callee FROM d WHERE hit IS NOT NULL
UNION ALL SELECT CAST(p AS VARCHAR), 'lib.L' || k || '.run', '<builtin>.super' FROM d WHERE own AND up
UNION ALL SELECT CAST(p AS VARCHAR), 'lib.L' || k || '.run', 'lib.L' || above || '.run' FROM d WHERE own AND up AND above IS NOT NULL""")
def pointed_calls(spark, sf_dir):
    """Who calls which method: receivers are found by points-to, methods along the resolution order, super() behind it."""
    return pointcalls.file_calls(programs(spark, sf_dir))
