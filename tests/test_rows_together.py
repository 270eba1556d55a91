"""Results with many rows a candidate: its rows lie together, so that files don't repeat its id all over."""

from itertools import groupby

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["H23_paac", "H24_apaac", "H25_qso_soc", "H26_autocorrelation", "H21_cetd"])
def test_rows_of_a_candidate_lie_together(spark, name):
    ids = [r.id for r in entry.queries()[name](spark, DATA).select("id").toLocalIterator(prefetchPartitions=True)]
    assert len([k for k, _ in groupby(ids)]) == len(set(ids)) < len(ids)
