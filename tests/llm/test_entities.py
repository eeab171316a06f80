import pytest

from hemispark.llm import entities as en

REG = [
    (1, "7th", "OAKRIDGE", "Victoria Oakridge", "AAA"), (1, "7th", "oakridge", "Victoria Oakridge", "BBB"), (1, "7th", "oakridge", "Victoria Oakridge", "BBB"), (2, "7th", "verdune", "Verdune, Henry", "AAA"),
    (3, "7th", "verdune", "Susan Verdune", None), (4, "7th", "blanc mortel", "James Blanc Mortel", "AAA"), (5, "7th", "puloutory", "Zacharie Puloutory", "AAA"), (6, "7th", "kelmino", "Ann Kelmino", "AAA"),
    (7, "7th", "kelmina", "Bo Kelmina", "AAA"), (8, "7th", "veaumure", "Susan Veaumure", "AAA"), (9, "8th", "oakridge", "Paul Oakridge", "AAA"), (None, "7th", "ghost", "A Ghost", "X"), (10, None, "ghost", "B Ghost", "X"), (11, "7th", None, None, "X"),
]
LABELS = {
    "Ms Oakridge": 1, "Ms Oakrdige": 1, "OAKRIDGE, V.": 1, "Vicky Oakridge": 1, "[00:10:11] Ms Oakridge (cont'd)": 1, "The Minister of Health (Ms V. Oakridge)": 1, "Ms Oakr.": 1, "Mr Verdune": None, "Mr H. Verdune": 2, "Harry Verdune": 2,
    "Verdune Susan": 3, "Mr Blanc Mortel": 4, "Mr Mortel": 4, "Mr Blanc Motrel": 4, "Mr Pulou....": 5, "Zach Pulutory": 5, "Ms Kelmino": 6, "Mr Kelmina": 7, "Mr Kelmine": None, "Dr Vomure": 8, "Madam Speaker": None, "The Prime Minister": None,
    "Mr Ghost": None, "Mr Nobody": None, "": None, None: None, "Ｍs Oａkridge": 1, "Mr Paul Oakridge": None,
}


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame(REG, "member_id long, assembly_term string, surname_key string, full_name string, party string")


def test_links(spark, registry):
    df = spark.createDataFrame([(i, x, "SEVENTH") for i, x in enumerate(LABELS)], "i int, speaker_raw string, assembly string").selectExpr("*", "99L AS term", "'x' AS surname")
    got = {r.speaker_raw: r.member_id for r in en.link_speakers(df, registry).collect()}
    assert got == LABELS
    assert en.link_speakers(df, registry).columns == [*df.columns, "member_id"]
    assert [r.member_id for r in en.link_speakers(spark.createDataFrame([("Mr Oakridge", "EIGHTH"), ("Mr Oakridge", None), ("Mr Oakridge", "NINTH")], "speaker_raw string, assembly string"), registry).orderBy("assembly").collect()] == [None, 9, None]


def test_variants_leave_out_the_plain_form(spark, registry):
    rows = [("d", 0, "Ms Oakridge"), ("d", 1, "ms OAKRIDGE"), ("d", 2, "Ms  Oakridge"), ("d", 3, "Ms Oakridge"), ("d", 4, "V. Oakridge"), ("d", 4, "V. Oakridge"), ("d", 5, "Mr Verdune")]
    df = spark.createDataFrame([(*r, "SEVENTH") for r in rows], "debate_id string, seq_index int, speaker_raw string, assembly string")
    got = {tuple(r) for r in en.variant_names(df, registry, ["debate_id", "seq_index"]).collect()}
    assert got == {("d", 2, 1), ("d", 4, 1)}
    assert en.variant_names(df.limit(0), registry, ["debate_id", "seq_index"]).count() == 0
    assert en.variant_names(df, registry.limit(0), ["debate_id", "seq_index"]).count() == 0


def test_learned_spellings_rematch(spark, registry):
    """A slip that a given name ties to a member lets a second slip on the bare label match as it stands."""
    rows = [("Zach Pulotory", "SEVENTH"), ("Mr Pulotory", "SEVENTH")]
    df = spark.createDataFrame(rows, "speaker_raw string, assembly string")
    assert {r.member_id for r in en.link_speakers(df, registry).collect()} == {5}


def test_hot_label(spark, registry):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'Ms Oakrige' ELSE concat('Mr Other', id) END AS speaker_raw", "'SEVENTH' AS assembly")
    assert en.link_speakers(df, registry).where("member_id = 1").count() == 1000


def test_one_slip_is_the_edit_distance():
    import random

    rng = random.Random(1)

    def osa(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
        b = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
        assert en.one_slip(a, b) == (osa(a, b) <= 1), (a, b)


def test_initials_of_learned_names_rematch(spark):
    registry = spark.createDataFrame([(1, "7th", "Tamarel", "Robert Tamarel", "A")], "member_id long, assembly_term string, surname_key string, full_name string, party string")
    df = spark.createDataFrame([("Bob Tamarel", "SEVENTH"), ("Mr B. Tamarel", "SEVENTH"), ("Mr K. Tamarel", "SEVENTH")], "speaker_raw string, assembly string")
    assert {r.speaker_raw: r.member_id for r in en.link_speakers(df, registry).collect()} == {"Bob Tamarel": 1, "Mr B. Tamarel": 1, "Mr K. Tamarel": None}
