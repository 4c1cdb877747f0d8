"""Secrets directly behind an equals sign."""

from corpuscope.llm import secrets


def test_a_secret_behind_an_equals_sign_is_scored(spark):
    found = ["key=wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY", "AWS_KEY=Zx8Qp2Lm9Vt4Rk7Wn3Bd6Hy1Jc5", "?a=1&sig=Zx8Qp2Lm9Vt4Rk7Wn3Bd6Hy1Jc5==&b=2"]
    rows = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    for r in secrets.scan(rows, [1.0] * secrets.STATES**2).collect():
        text = found[r["doc_id"]]
        start = text.index("=", 3 if "&" in text else 0) + 1 if "&" not in text else text.index("Zx8")
        end = len(text) if "&" not in text else text.index("&b")
        assert r["spans"] == f"random:{start}:{end}"


def test_least_length(spark):
    rows = spark.createDataFrame([(0, "id Zx8Qp2Lm9Vt4Rk7W end"), (1, "id Zx8Qp2Lm9Vt4Rk7 end"), (2, "id 4111111111111111 end"), (3, "id 41111111111111112222 end")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_random"] for r in secrets.scan(rows, [1.0] * secrets.STATES**2).collect()} == {0: 1, 1: 0, 2: 0, 3: 1}
