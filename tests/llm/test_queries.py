import re

import __spark_entry__


def test_one_query_for_each_operator_and_the_pipeline():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert len([x for x in names if re.match(rf"op{n}_", x)]) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
