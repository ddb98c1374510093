import pytest
from pyspark.sql import functions as F

from spanloom.functions import bodies, intent, labels, messages, outcome, paths, text

INTENTS = [
    ("Fix the failing build — it throws a TypeError on startup", "debug"),
    ("The login button does nothing when clicked, can you debug it?", "debug"),
    ("Add a dark-mode toggle to the settings page", "feature"),
    ("Implement a /health endpoint that returns 200", "feature"),
    ("Refactor the auth module to remove the duplication", "refactor"),
    ("Rename getUser to fetchUser everywhere", "refactor"),
    ("Explain how the caching layer works", "explain"),
    ("What does this regex actually match?", "explain"),
    ("Write unit tests for the parser", "test"),
    ("Set up the CI pipeline to run on every push", "ops"),
    ("Bump the eslint dependency and commit the change", "ops"),
    ("Research the best charting library for React", "research"),
    ("Compare two databases for our use case", "research"),
    ("hey", "other"),
    ("", "other"),
    (None, "other"),
    ("  \n", "other"),
    # An accented letter is no word character, so the cue stands alone.
    ("éfixé", "debug"),
    ("prefix", "other"),
    ("ready? ", "explain"),
    ("why is it that they fail", "debug"),
    ("Let's break it down into etl steps", "feature"),
    ("Why does the import keep failing unexpectedly?", "debug"),
]
ACTIONS = [
    ('git commit -m "x"', "vcs"), ("  gh pr create", "vcs"), ("pytest tests/", "test"),
    ("pnpm test", "test"), ("npm run test", "test"), ("yarn exec eslint .", "verify"),
    ("rg pattern", "search"), ("pnpm typecheck", "verify"), ("pnpm install", "build"),
    ("make all", "build"), ("ls -la", "run"), ("", "run"), (None, "run"), ("pnpm", "run"),
    ("cd packages/x && git commit -m x", "vcs"), ("CD src; grep -rn foo", "search"),
    ("cd a;b;grep x", "search"), ("cd /tmp &&\n pnpm test", "test"),
]
TYPES = [
    ("src/a.ts", "source code"), ("a.e2e.test.ts", "e2e test"), ("a.spec.JSX", "unit test"),
    (".github/workflows/ci.yml", "CI/CD config"), ("x/.gitignore", "VCS artifact"),
    ("CLAUDE.md", "agent config"), ("tsconfig.base.json", "build config"),
    ("turbo.json", "build config"), (".eslintrc.cjs", "linter config"),
    (".prettierrc", "formatter config"), ("yarn.lock", "lockfile"), ("pyproject.toml", "manifest"),
    (".env.local", "secret / env"), ("README.md", "documentation"), ("data.bin", "unknown"),
    ("/home/me/.claude/settings.json", "claude code user settings"),
    ("/home/me/.claude/skills/x.md", "claude code config"),
    ("/r/.claude/worktrees/w1/src/a.py", "source code"), (None, None),
]
PATHS = [
    ("/repo/src/a.ts", "/repo", "src/a.ts"),
    ("/repo/.claude/worktrees/w1/src/a.ts", "/repo", "src/a.ts"),
    ("/repo/.claude/worktrees/w2/src/a.ts", "/repo/.claude/worktrees/w2", "src/a.ts"),
    ("/x/worktrees/w/src/a.ts", None, "src/a.ts"),
    ("/repo", "/repo", None), ("", "/repo", None), (None, "/repo", None),
    ("/home/me/.claude/settings.json", "/repo", ".claude/settings.json"),
    ("/repository/a.ts", "/repo", "repository/a.ts"),
    ("/repo/a.ts", "/repo/", "a.ts"), ("/repo/.claude/worktrees/w1", "/repo", None),
]
FAILURES = [
    ("String to replace not found in file.", "invalid_args"),
    ("Error: ENOENT: no such file or directory", "not_found"),
    ("bash: foo: command not found", "not_found"), ("EACCES: permission denied", "permission"),
    ("Command timed out after 2m", "timeout"), ("Invalid JSON", "invalid_args"),
    ("exit code 1", "nonzero_exit"), ("exit code 0", "other"), ("boom", "other"),
]


def column(spark, values, schema="v string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")


def run(df, col):
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def test_intents(spark):
    df = intent.with_intent(column(spark, [p for p, _ in INTENTS]), "v", "got")
    assert run(df, "got") == [w for _, w in INTENTS]


def test_shell_actions(spark):
    df = labels.with_shell_action(column(spark, [c for c, _ in ACTIONS]), "v", "got")
    assert run(df, "got") == [w for _, w in ACTIONS]


def test_path_types(spark):
    df = labels.with_path_type(column(spark, [p for p, _ in TYPES]), "v", "got")
    assert run(df, "got") == [w for _, w in TYPES]


def test_repo_paths(spark):
    rows = [(i, p, c) for i, (p, c, _) in enumerate(PATHS)]
    df = spark.createDataFrame(rows, "i int, p string, c string")
    assert run(paths.with_repo_path(df, "p", "c", "got"), "got") == [w for *_, w in PATHS]


def test_package_and_host(spark):
    df = column(spark, ["packages/web/a.ts", "x/Apps/b/c.ts", "src/a.ts", "packages/a.ts"])
    assert run(df, paths.package(F.col("v"))) == ["web", "b", None, None]
    df = column(spark, ["https://www.a.io/x", "b.org", "http://", "ftp://q/z", None])
    assert run(df, paths.url_host(F.col("v"))) == ["a.io", "b.org", "http://", "ftp:", None]


def test_error_kinds_and_messages(spark):
    df = outcome.with_error_kind(column(spark, [t for t, _ in FAILURES]), "v", "got")
    assert run(df, "got") == [w for _, w in FAILURES]
    df = column(spark, ["  x ", "a" * 500, "a" * 498 + " " + "b" * 9, " ", None])
    got = run(outcome.with_error_message(df, "v", "got"), "got")
    assert got == ["x", "a" * 500, "a" * 498 + "…", None, None]


def test_text_helpers(spark):
    df = column(spark, ["12px", " -3", "x", None, "1.5e3usd"])
    assert run(df, text.leading_int(F.col("v"))) == [12, -3, None, None, 1]
    assert run(df, text.leading_float(F.col("v"))) == [12.0, -3.0, None, None, 1500.0]
    df = column(spark, ["ab", "\U0001f600", "é"])
    assert run(df, text.utf16_length(F.col("v"))) == [2, 2, 1]
    assert run(column(spark, ["﻿  a b\t"]), text.trim(F.col("v"))) == ["a b"]


CALLS = [
    ("Read", '{"file_path":"/r/a.py"}', "read source code", "/r/a.py", None, None),
    ("Read", "{}", "read", None, None, None),
    ("NotebookEdit", '{"notebook_path":"/r/n.md","edit_mode":"insert"}',
     "add cell to documentation", "/r/n.md", None, None),
    ("NotebookEdit", '{"edit_mode":"delete"}', "delete cell from", None, None, None),
    ("LS", '{"path":"/r"}', "list unknown", "/r", None, None),
    ("WebFetch", '{"url":"https://www.a.io/x","prompt":" sum "}', "fetch web page", None, "a.io",
     "sum"),
    ("Bash", '{"command":"git status","description":" look "}', "version control", None, None,
     "look"),
    ("Bash", None, "run", None, None, None),
    ("mcp__Some  Tool", "{}", "mcp__some tool", None, None, None),
    (None, None, "", None, None, None),
    ("Skill", "{}", "use skill", None, None, None),
]


def test_tool_labels(spark):
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(CALLS)], "i int, n string, t string")
    got = labels.with_tool_labels(df, "n", "t").orderBy("i")
    rows = got.select("tool_label", "raw_path", "url", "tool_comment").collect()
    assert [tuple(r) for r in rows] == [c[2:] for c in CALLS]


def test_vocabulary_covers_the_rules(spark, monkeypatch):
    labels.check_vocabulary()
    assert labels.vocabulary(spark).filter("kind = 'action'").count() == len(labels.ACTIONS)
    monkeypatch.setattr(labels, "TASK_ACTIONS", [(["x"], "no-such-action")])
    with pytest.raises(ValueError, match="no-such-action"):
        labels.check_vocabulary()


def test_result_texts(spark):
    blocks = [
        '{"type":"tool_result","content":"plain [1]"}',
        '{"type":"tool_result","content":[{"type":"text","text":" a"},{"type":"tool_reference"},"b"]}',
        '{"type":"tool_result"}',
        '{"type":"tool_result","content":"[\\"not\\", \\"blocks\\"]"}',
    ]
    got = run(column(spark, blocks), messages.result_text(F.col("v")))
    assert got == ["plain [1]", "a\n\nb", "", '["not", "blocks"]']


BODIES = [
    ('{"messages":[{"role":"user","content":"hi"}]}', ['{"role":"user","content":"hi"}']),
    ('{"system":"be brief","messages":[]}', ['{"role":"system","content":"be brief"}']),
    ('{"system":[{"type":"text","text":"s"}],"messages":[]}',
     ['{"role":"system","content":[{"type":"text","text":"s"}]}']),
    (r'{\"messages\":[{\"role\":\"user\",\"content\":\"hi\"}]}', ['{"role":"user","content":"hi"}']),
    (r'"{\"messages\":[{\"role\":\"user\",\"content\":\"hi\"}]}"',
     ['{"role":"user","content":"hi"}']),
    ('{"messages":[{"role":"user","content":"cut he [TRUNCATED 12 bytes]',
     ['{"role":"user","content":"cut he"}']),
    ('{"messages":[{"role":"user","content":"a"},', ['{"role":"user","content":"a"}']),
    (r'{\"messages\":[{\"role\":\"user\",\"content\":\"cu[TRUNCATED]', ['{"role":"user","content":"cu"}']),
    ("garbage", None), ("[1]", None), ('{"x":1}', None), (None, None),
]


def test_request_bodies(spark):
    df = column(spark, [b for b, _ in BODIES]).withColumn("d", bodies.decoded(F.col("v")))
    assert run(df, bodies.request_messages(F.col("d"))) == [w for _, w in BODIES]


def test_response_bodies(spark):
    df = column(spark, ['{"content":[{"type":"text"}],"stop_reason":"end"}', '{"content":[{"a"', "{}"])
    assert run(df, bodies.response_messages(F.col("v"))) == [['{"type":"text"}'], None, None]
    assert run(df, bodies.stop_reason(F.col("v"))) == ["end", None, None]
