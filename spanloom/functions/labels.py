"""Input-independent action labels of tool calls, compiled from rule data to expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.functions.paths import strip_worktree, url_host

# ---- Fixed values: vocabulary, rules and patterns that make up the labels ----

ACTIONS = [
    ("read", "work", "read"),
    ("search", "work", "search"),
    ("write", "work", "write"),
    ("edit", "work", "edit"),
    ("delete", "work", "delete"),
    ("refactor", "work", "refactor"),
    ("run", "work", "run"),
    ("build", "work", "build"),
    ("test", "work", "run tests"),
    ("lint", "work", "lint"),
    ("format", "work", "format"),
    ("typecheck", "work", "typecheck"),
    ("verify", "work", "verify"),
    ("vcs", "work", "version control"),
    ("debug", "work", "debug"),
    ("review", "work", "review"),
    ("fetch", "work", "fetch"),
    ("search-web", "work", "search the web"),
    ("configure", "work", "configure"),
    ("plan", "meta", "plan next steps"),
    ("invoke", "meta", "invoke"),
    ("delegate", "meta", "delegate"),
    ("respond", "meta", "respond"),
    ("clarify", "meta", "ask the user"),
    ("use-skill", "meta", "use skill"),
    ("generate-title", "harness", "generate session title"),
    ("predict", "harness", "predict next user prompt"),
    ("load-schema", "harness", "load tool schema"),
    ("act", "escape", "act"),
]

OBJECTS = [
    ("business-logic", "business logic"),
    ("source-code", "source code"),
    ("test-code", "tests"),
    ("unit-test", "unit test"),
    ("e2e-test", "e2e test"),
    ("fixture", "fixture"),
    ("manifest", "manifest"),
    ("lockfile", "lockfile"),
    ("build-config", "build config"),
    ("linter-config", "linter config"),
    ("formatter-config", "formatter config"),
    ("ci-cd", "CI/CD config"),
    ("documentation", "documentation"),
    ("agent-config", "agent config"),
    ("vcs-artifact", "VCS artifact"),
    ("type-schema", "types / schema"),
    ("dependency", "dependency"),
    ("infra", "infrastructure"),
    ("secret", "secret / env"),
    ("web-resource", "web resource"),
    ("shell", "shell command"),
    ("task-list", "task list"),
    ("tool", "tool"),
    ("repo", "repository"),
    ("user", "user"),
    ("unknown", "unknown"),
]

# Paths the agent owns, matched before the conventions and with case.
WELL_KNOWN_PATHS = [
    (r"/\.claude/settings\.json$", "claude code user settings"),
    (r"/\.claude/", "claude code config"),
]

# File roles by path; the first match wins, case does not matter.
PATH_CONVENTIONS = [
    (r"\.e2e\.test\.[tj]sx?$", "e2e-test"),
    (r"\.(test|spec)\.[tj]sx?$", "unit-test"),
    (r"(^|/)\.github/workflows/", "ci-cd"),
    (r"(^|/)(\.husky/|\.git/hooks/)", "vcs-artifact"),
    (r"(^|/)\.gitignore$", "vcs-artifact"),
    (r"(^|/)(\.claude/|claude\.md$|agents\.md$)", "agent-config"),
    (
        r"(^|/)(tsconfig[^/]*\.json|(tsup|vite|vitest|jest|babel|webpack|rollup)\.config\.[a-z]+)$",
        "build-config",
    ),
    (
        r"(^|/)(pnpm-workspace\.yaml|turbo\.json|nx\.json|lerna\.json|renovate\.json|knip\.(json|jsonc|ts)|\.npmrc|\.nvmrc)$",
        "build-config",
    ),
    (r"(^|/)(eslint\.config\.[a-z]+|\.eslintrc[^/]*)$", "linter-config"),
    (r"(^|/)(prettier\.config\.[a-z]+|\.prettierrc[^/]*)$", "formatter-config"),
    (
        r"(^|/)(pnpm-lock\.yaml|yarn\.lock|package-lock\.json|bun\.lockb|cargo\.lock|go\.sum|poetry\.lock)$",
        "lockfile",
    ),
    (r"(^|/)(package\.json|cargo\.toml|go\.mod|pyproject\.toml|pom\.xml)$", "manifest"),
    (r"(^|/)\.env", "secret"),
    (r"\.(md|mdx|rst)$", "documentation"),
    (r"\.(ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|rb|kt|swift|c|cc|cpp|h|hpp)$", "source-code"),
]
UNKNOWN_OBJECT = "unknown"

# Tools that act on a path: tool -> (input field, verb put before the object).
PATH_TOOLS = {
    "Read": ("file_path", "read"),
    "NotebookRead": ("notebook_path", "read"),
    "LS": ("path", "list"),
    "Edit": ("file_path", "edit"),
    "MultiEdit": ("file_path", "edit"),
    "Write": ("file_path", "write"),
    "NotebookEdit": ("notebook_path", "edit"),
}
NOTEBOOK_EDIT_MODES = {"insert": "add cell to", "delete": "delete cell from"}

# Tools with one label whatever their input.
PLAIN_TOOLS = {
    "Glob": "find files",
    "Grep": "search files",
    "WebFetch": "fetch web page",
    "WebSearch": "search the web",
    "Task": "delegate to subagent",
    "Agent": "delegate to subagent",
    "TodoWrite": "update task list",
    "ExitPlanMode": "present plan for approval",
    "AskUserQuestion": "ask the user",
    "Skill": "use skill",
    "SlashCommand": "run command",
    "ToolSearch": "load tool schema",
    "TaskCreate": "create task",
    "TaskUpdate": "update task",
    "SendUserFile": "send file to the user",
    "BashOutput": "read command output",
    "KillShell": "kill background command",
}
SHELL_TOOL = "Bash"
URL_TOOLS = {"WebFetch": "url"}
COMMENT_FIELDS = {"Bash": "description", "WebFetch": "prompt"}
WEAK_MODEL_LABEL = "process result with weak model"

RUNNERS = ["pnpm", "npm", "yarn", "npx", "bun", "pnpx"]
RUNNER_VERBS = ["run", "run-script", "exec"]
TOKEN_ACTIONS = [
    (["git", "gh", "jj", "hg", "svn"], "vcs"),
    (["pytest", "jest", "vitest", "mocha", "rspec", "phpunit"], "test"),
    (["grep", "rg", "ag", "ack", "find", "fd", "locate", "glob"], "search"),
    (
        ["make", "cmake", "gradle", "mvn", "bundle", "pip", "pip3", "poetry", "brew", "apt",
         "apt-get", "docker"],
        "build",
    ),
]
TASK_ACTIONS = [
    (["test", "test:watch"], "test"),
    (["lint", "format", "format:check", "typecheck", "tsc", "check", "eslint", "prettier"],
     "verify"),
    (["install", "ci", "build", "add", "create"], "build"),
]
DEFAULT_ACTION = "run"

PLAN_LABEL = "plan next steps"
TITLE_ACTION = "generate-title"
TITLE_KEY = "title"
SUGGESTION_ACTION = "predict"
SUGGESTION_PREFIX = "[SUGGESTION MODE"
RESPOND_ACTION = "respond"
SKILL_CALL_LABEL = "decide on skill use"
CALL_PREFIX = "invoke "

# ---- End of fixed values ----

_ACTION_LABELS = {i: label for i, _, label in ACTIONS}
_OBJECT_LABELS = dict(OBJECTS)


def check_vocabulary() -> None:
    """Every id a rule uses must be in the vocabulary."""
    used = {a for _, a in TOKEN_ACTIONS + TASK_ACTIONS}
    used |= {DEFAULT_ACTION, TITLE_ACTION, SUGGESTION_ACTION, RESPOND_ACTION}
    missing = sorted(used - set(_ACTION_LABELS))
    missing += sorted({o for _, o in PATH_CONVENTIONS} - set(_OBJECT_LABELS))
    if missing:
        raise ValueError(f"rules use ids outside the vocabulary: {', '.join(missing)}")


check_vocabulary()


def action_label(action: str) -> str:
    return _ACTION_LABELS.get(action, action)


def vocabulary(spark: SparkSession) -> DataFrame:
    """The label vocabulary as ``(kind, id, label, grouping)``."""
    rows = [("action", i, label, group) for i, group, label in ACTIONS]
    rows += [("object", i, label, None) for i, label in OBJECTS]
    return spark.createDataFrame(rows, "kind string, id string, label string, grouping string")


def field(tool_input: Column, name: str) -> Column:
    """String field of a JSON input; empty when absent."""
    return F.coalesce(F.get_json_object(tool_input, f"$.{name}"), F.lit(""))


def _first(rules: list[tuple[Column, object]], default: Column) -> Column:
    chain = reduce(
        lambda c, r: (c.when if c is not None else F.when)(
            r[0], r[1] if isinstance(r[1], Column) else F.lit(r[1])
        ),
        rules,
        None,
    )
    return chain.otherwise(default)


def _lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, null when absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def _by_word(rules: list[tuple[list[str], str]]) -> dict[str, str]:
    return {word: action for words, action in rules for word in words}


# The steps below add columns one after the other. A value that several rules test is computed in
# a step of its own, so the plan evaluates it once per row and each step stays compilable.


def with_path_type(df: DataFrame, path: str, out: str) -> DataFrame:
    """Object label of the path in column ``path``; null for a null path."""
    at = F.col("__path")
    rules = [(at.rlike(p), label) for p, label in WELL_KNOWN_PATHS]
    rules += [(at.rlike("(?i)" + p), _OBJECT_LABELS[o]) for p, o in PATH_CONVENTIONS]
    label = _first(rules, F.lit(_OBJECT_LABELS[UNKNOWN_OBJECT]))
    return (
        df.withColumn("__path", strip_worktree(F.col(path)))
        .withColumn(out, F.when(at.isNotNull(), label))
        .drop("__path")
    )


def with_shell_action(df: DataFrame, command: str, out: str) -> DataFrame:
    """Action id of the shell command in column ``command``; a missing command runs something."""
    ws, black = f"[{text.WHITESPACE}]", f"[^{text.WHITESPACE}]"
    moved = F.regexp_extract(
        F.col("__whole"), rf"(?is)^cd{ws}+{black}+{ws}*(?:&&|;){ws}*(.+)\z", 1
    )
    second = F.get("__tokens", F.lit(1))
    task = F.when(second.isin(RUNNER_VERBS), F.get("__tokens", F.lit(2))).otherwise(second)
    found = F.when(
        F.col("__head").isin(RUNNERS), _lookup(F.col("__task"), _by_word(TASK_ACTIONS))
    ).otherwise(_lookup(F.col("__head"), _by_word(TOKEN_ACTIONS)))
    steps = [
        ("__whole", text.trim(F.coalesce(F.col(command), F.lit("")))),
        ("__moved", moved),
        ("__tokens", F.split(
            F.when(F.col("__moved") != "", F.col("__moved")).otherwise(F.col("__whole")), f"{ws}+"
        )),
        ("__head", F.get("__tokens", F.lit(0))),
        ("__task", F.coalesce(task, F.lit(""))),
        (out, F.coalesce(found, F.lit(DEFAULT_ACTION))),
    ]
    for name, col in steps:
        df = df.withColumn(name, col)
    return df.drop("__whole", "__moved", "__tokens", "__head", "__task")


def label_of_action(action: Column) -> Column:
    return F.coalesce(_lookup(action, _ACTION_LABELS), action)


def with_tool_labels(df: DataFrame, name: str, tool_input: str) -> DataFrame:
    """Add ``tool_label``, ``raw_path``, ``url`` and ``tool_comment`` of a tool call.

    ``tool_input`` must be valid JSON or null. Unlisted tools are labelled by their lower-cased
    name.
    """
    tool, given = F.col(name), F.col(tool_input)
    nothing = F.lit(None).cast("string")
    fields = sorted({f for f, _ in PATH_TOOLS.values()})
    raw_field = _first(
        [
            (tool.isin([t for t, (f, _) in PATH_TOOLS.items() if f == name]), field(given, name))
            for name in fields
        ],
        nothing,
    )
    url_field = _first([(tool == t, field(given, f)) for t, f in URL_TOOLS.items()], nothing)
    note = _first([(tool == t, field(given, f)) for t, f in COMMENT_FIELDS.items()], nothing)
    mode = F.when(tool == "NotebookEdit", field(given, "edit_mode"))
    verb = F.coalesce(
        _lookup(mode, NOTEBOOK_EDIT_MODES), _lookup(tool, {t: v for t, (_, v) in PATH_TOOLS.items()})
    )
    df = df.withColumns(
        {
            "__raw": text.trim(raw_field),
            "__url": text.trim(url_field),
            "__note": text.trim(note),
            "__verb": verb,
            "__command": F.when(tool == SHELL_TOOL, field(given, "command")),
        }
    ).withColumns(
        {
            "raw_path": text.first_non_empty(F.col("__raw")),
            "url": url_host(text.first_non_empty(F.col("__url"))),
            "tool_comment": text.first_non_empty(F.col("__note")),
        }
    )
    df = with_shell_action(with_path_type(df, "raw_path", "__object"), "__command", "__action")
    known = F.coalesce(
        F.when(F.col("__verb").isNotNull(), F.concat_ws(" ", "__verb", "__object")),
        _lookup(tool, PLAIN_TOOLS),
        F.when(tool == SHELL_TOOL, label_of_action(F.col("__action"))),
    )
    other = text.squeeze(F.lower(F.coalesce(tool, F.lit(""))))
    return df.withColumn("tool_label", F.coalesce(known, other)).drop(
        "__raw", "__url", "__note", "__verb", "__command", "__object", "__action"
    )


def hands_to_weak_model(name: Column, tool_input: Column) -> Column:
    """Fetches with a prompt pass their result through a weak model."""
    return (name == "WebFetch") & field(tool_input, "prompt").rlike(r"[^\n\r\u2028\u2029]")


def bash_command(tool_input: Column) -> Column:
    """Non-empty ``command`` of any tool input."""
    return text.first_non_empty(F.get_json_object(tool_input, "$.command"))
