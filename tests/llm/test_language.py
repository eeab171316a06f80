import numpy as np
import pytest

from hemispark.llm import language as la

EN = ["The minister told the house that the hospital would open in {}.", "I would ask whether the answer can be circulated before {}.", "We have listened with care to what the members said on {}.", "Nobody has explained why the road should wait until {}."]
FR = ["Je voudrais que cela soit noté au procès-verbal du {}.", "Le ministre peut-il nous dire ce qui a été prévu pour le {}.", "Les habitants me parlent chaque semaine de la maternité depuis {}.", "Cette mesure ne règle en rien le problème des loyers de {}."]
MFE = ["Mo pe dimann minis la ki li pe fer pou lopital depi {}.", "Bann dimounn pe plengne toule zour lor larivier depi {}.", "Zot ti promet nou ki sime la ti pou fini dan lane {}.", "Nou bizin amelior lavi bann travayer avan lane {}."]


DATA = "/root/testdata/sf0.01/utterances.parquet"


@pytest.fixture(scope="module")
def network(spark):
    df = spark.read.parquet(DATA).where("not is_stage_direction")
    return la.fit_language(df, "text", "language", ["debate_id", "seq_index"], ["en", "fr", "mfe"])


def test_held_out(network):
    texts = {"en": "May I know whether the members have listened to the answer?", "fr": "Nous voudrions que le ministre parle des habitants.", "mfe": "Bann minis pe promet nou ki zot pou amelior lopital."}
    for language, text in texts.items():
        assert la.segments_of([text], network)[0][0][0] == language


def test_mixed_and_borrowed(network):
    text = EN[0].format(2015) + " " + FR[0].format(2016) + " " + FR[1].format(2017) + " " + MFE[0].format(2018)
    got = la.segments_of([text], network)[0]
    assert [s[0] for s in got] == ["en", "fr", "mfe"] and all(0.5 < s[1] <= 1 for s in got)
    assert [s[0] for s in la.segments_of(["The minister said this status quo has no raison d'être any more in the house."], network)[0]] == ["en"]


def test_gradients_are_those_of_the_loss():
    net = la.ByteNetwork(["a", "b"], seed=1)
    rng = np.random.default_rng(0)
    grid, labels = rng.integers(97, 103, (6, la.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    weight = np.ones(2)

    def loss():
        p = net.probabilities(grid)
        return float(-np.log(p[np.arange(6), labels]).mean())

    grads = net._gradients(grid, labels, weight)
    for param, grad in zip(net._parameters(), grads):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old, eps = param[at], 1e-2
        values = []
        for step in (eps, -eps):
            param[at] = old + step
            net._tables = None
            values.append(loss())
        param[at] = old
        net._tables = None
        assert (values[0] - values[1]) / (2 * eps) == pytest.approx(float(grad[at]), rel=0.15, abs=2e-3)


def test_windows_cover_the_whole_text():
    text = "abc " * 5000
    grid = la.windows(text)
    assert grid.shape[1] == la.WINDOW and (grid[:, : la.STRIDE].reshape(-1) > 0).sum() >= len(text) - la.WINDOW
    assert la.windows("").shape == (1, la.WINDOW)


def test_operator(spark, network):
    rows = [("d", 0, EN[0].format(1), "en"), ("d", 1, EN[1].format(2), None), ("d", 1, EN[1].format(2), None), ("d", 2, MFE[1].format(3), "fr"), ("d", 3, EN[0].format(4) + " " + FR[2].format(5), "en"), ("d", 4, "Oui.", None), ("d", 5, None, "en"), ("d", 6, "", "en"), ("d", 7, "1234 " * 30, "en")]
    df = spark.createDataFrame(rows, "debate_id string, seq_index int, text string, language string")
    got = {tuple(r) for r in la.wrong_languages(df, ["debate_id", "seq_index"], "text", "language", network).collect()}
    assert got == {("d", 1, "en"), ("d", 2, "mfe"), ("d", 3, "en"), ("d", 3, "fr")}
    assert la.wrong_languages(df.limit(0), ["debate_id", "seq_index"], "text", "language", network).count() == 0
    assert la.wrong_languages(df, ["debate_id", "seq_index"], "text", "language", None).count() == 0
    assert la.train([], ["en", "fr"]) is None
    chosen = la.labelled_sample(df, "text", "language", ["debate_id", "seq_index"], ["en", "fr"], rows=1)
    assert len(chosen) <= 4
