import pytest

from logloom.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_reads_a_given_table(spark, name):
    """Without the tables there is nothing to run on: no query has rows of its own alone."""
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|No such file"):
        QUERIES[name](spark, "/nowhere/at/all").count()
