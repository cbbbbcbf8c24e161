from plexmat.operators import components


def test_few_edges_take_two_steps_and_equal_the_rounds(spark, monkeypatch):
    """A long path with shuffled ids, repeated edges, self loops and null ends; rounds of joins give the same."""
    path = [(7 * i % 501, 7 * (i + 1) % 501) for i in range(500)]
    e = spark.createDataFrame([*path, *path[:9], (900, 900), (None, 3), (901, None), (-5, 600)], "src long, dst long")
    steps, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label: steps.append(label) or write(df, label))
    one = sorted(components.connected_components(e).collect())
    assert len(steps) == 2
    assert one == sorted(components.connected_components(e, small=0).collect()) and len(steps) > 6
    assert dict(one) == {**dict.fromkeys(range(501), 0), 900: 900, -5: -5, 600: -5}
    assert components.connected_components(e.limit(0)).count() == 0
    texts = e.selectExpr("string(src) AS src", "string(dst) AS dst")
    assert components.connected_components(texts).count() == 504
