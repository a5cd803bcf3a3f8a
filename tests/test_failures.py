from mnemolake.operators import sessions


def test_an_error_without_an_exit_code_is_a_failure_too(spark):
    rows = [("s1", 1, "tool", "TypeError: cannot read properties of undefined"), ("s1", 2, "tool", "command: make all\nexited with code 2"), ("s1", 3, "tool", "exited with code 0"), ("s1", 4, "user", "TypeError: cannot read properties of undefined")]
    got = sessions.exit_failures(spark.createDataFrame(rows, "session_id string, pos long, role string, text string")).collect()
    assert sorted((r.key.split("|")[0], r.pos, r.code) for r in got) == [("error_pattern", 1, None), ("exit_code", 2, 2)]
