"""What scans have read, from Spark's own metrics."""


def scanned_rows(spark, run, source):
    """Rows that scans of a source put out while ``run`` is going on."""
    store = spark._jsparkSession.sharedState().statusStore()
    known = store.executionsList().size()
    result = run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    total, executions = 0, store.executionsList()
    for i in range(known, executions.size()):
        identity = executions.apply(i).executionId()
        values = store.executionMetrics(identity)
        nodes = store.planGraph(identity).allNodes()
        for n in range(nodes.size()):
            node = nodes.apply(n)
            if node.name().strip().startswith(f"Scan {source}"):
                for m in range(node.metrics().size()):
                    metric = node.metrics().apply(m)
                    if metric.name() == "number of output rows":
                        value = values.get(metric.accumulatorId())
                        total += int(value.get().replace(",", "")) if value.isDefined() else 0
    return result, total
