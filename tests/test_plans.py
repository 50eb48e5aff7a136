"""Plan shape: broadcast prototypes, no shuffle of the sample side, pushdown."""

from openbound.operators import score as S
from openbound.plans import catalog
from tests.conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_is_map_only(spark):
    os_, protos = catalog.emb_setup(spark, SF001)
    pred = S.reject_scalar(os_.split("test").select("row_id", "x"), protos)
    plan = _plan(pred)
    assert "BroadcastNestedLoopJoin" in plan
    assert "BroadcastExchange" in plan
    # the only shuffles are under the (tiny) known-label lookup; none between scan and scoring
    scan_side = plan.split("BroadcastNestedLoopJoin")[1]
    first_child = scan_side.split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in first_child.split("FileScan")[0]


def test_column_pruning_and_pushdown(spark):
    import re
    os_, _ = catalog.emb_setup(spark, SF001)
    df = os_.split("test").select("row_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all("embedding" not in s for s in schemas)   # vectors never read
    docs = catalog.q_p15_distinct_targets(spark, SF001)
    assert "embedding" not in "".join(re.findall(r"ReadSchema: (struct<[^>]*>)",
                                                 docs._jdf.queryExecution().executedPlan().toString()))


def test_confusion_aggregates_before_shuffle(spark):
    df = catalog.q_m2_confusion(spark, SF001)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in plan and "partial" in plan.lower()
