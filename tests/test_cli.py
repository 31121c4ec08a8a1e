import json

import pytest

from lodestar import __main__ as cli
from lodestar.operators.cases import SuspectSnapshot
from lodestar.sinks.tables import load
from lodestar.sources import snapshots
from tests.support import feed_row
from tests.test_io import at


def test_parse_carries_and_refuses(spark, tmp_path, capsys):
    folder, out = f"file://{tmp_path}/snap", f"file://{tmp_path}/out"
    store = lambda day, n: snapshots.store(spark, folder, json.dumps({"data": [feed_row(f"337-{i}") for i in range(n)]}).encode(), at(day))
    store("2026-09-01", 30)
    assert cli.parse(spark, folder, out)["removed"] == 0
    store("2026-09-02", 28)
    assert cli.parse(spark, folder, out)["removed"] == 2
    back = load(spark, f"{out}/cases")
    assert back.count() == 30 and back.filter("withdrawn").count() == 2
    store("2026-09-03", 5)
    with pytest.raises(SuspectSnapshot):
        cli.parse(spark, folder, out)
    assert load(spark, f"{out}/cases").filter("withdrawn").count() == 2
    assert spark.read.csv(f"{out}/log", header=True).filter("error is not null").count() == 1
    assert cli.main(["queries"]) == 0 and "firm_leaderboard" in capsys.readouterr().out
