"""What queries leave in the shared folder."""

import sys

from fairlead.operators import shared
from fairlead.plans import registry


def test_queries_leave_only_what_their_result_reads(spark, sf):
    before = shared.release(spark, since=sys.maxsize)
    q = registry.queries()
    for name in ("knn_context", "knn_stored_index", "grid_pyramid", "plan_voyages"):
        already = len(shared._written)
        found = q[name](spark, sf)
        kept = found.inputFiles()
        assert all(any(path in f for f in kept) for path in shared._written[already:]), name
        assert found.count() > 0
    assert shared.release(spark, since=before) == before
