from paceforge.plans import serve


def test_answers(spark, sf_dir):
    assert serve.sessions(spark, sf_dir).count() == 4
    assert serve.driver_laps(spark, sf_dir, 2, 1).first().lap_number == 1
    assert serve.strategy(spark, sf_dir, 2).count() > 0
    assert serve.overtakes(spark, sf_dir, 2).columns == ["round", "lap_number", "gainer", "loser"]
    assert 0 < serve.telemetry(spark, sf_dir, 1, 5).count() <= 600


def test_a_driver_is_level_with_itself(spark, sf_dir):
    rows = serve.compare(spark, sf_dir, 1, 1, 5, 20).collect()
    assert len(rows) == 21 and all(r.delta_s == 0 for r in rows)
