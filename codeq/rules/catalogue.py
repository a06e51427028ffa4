"""The constant dimensions: pattern rules, severities, categories, languages, badges."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codeq.functions.text import java_pattern, needles_hold, sure_needles

# Domains, in order of seriousness where there is one.
SEVERITIES = ("critical", "error", "warning", "info")
CATEGORIES = (
    "style", "complexity", "security", "performance",
    "maintainability", "bug", "documentation", "duplication",
)
STATUSES = ("pending", "analyzing", "complete", "failed")
LANGUAGES = (
    "python", "javascript", "typescript", "java", "cpp", "c", "go", "rust", "unknown",
)

# File extension to language, and the extensions the upload form accepts.
EXTENSION_LANGUAGE = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript",
    "tsx": "typescript", "java": "java", "cpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "c": "c", "h": "c", "go": "go", "rs": "rust",
}
ACCEPTED_EXTENSIONS = (
    "py", "js", "ts", "jsx", "tsx", "java", "cpp", "cc", "c", "h", "go", "rs",
)

# Upload limits.
MAX_FILE_BYTES = 500 * 1024
MAX_FILES_PER_REVIEW = 20


@dataclass(frozen=True)
class PatternRule:
    """One text rule, built in or a user's own; a faulty one is refused when it is made.

    ``pattern`` is a Python regular expression, matched without regard to case and line by line for
    ``^`` and ``$``. ``needles`` are lower-case strings of which a text must hold at least one for
    the pattern to match at all; they spare most texts the pattern. Without needles those that the
    pattern shows by itself are taken (``must_hold``), and if it shows none it is always tried.
    """

    rule_id: str
    severity: str
    pattern: str
    title: str
    message: str = ""
    fix: str | None = None
    needles: tuple[str, ...] = ()
    fixable: bool = False

    def __post_init__(self):
        if self.severity not in SEVERITIES:
            raise ValueError(f"{self.rule_id}: {self.severity} is not one of {SEVERITIES}")
        java_pattern(self.pattern)
        if self.needles and not needles_hold(self.pattern, self.needles):
            raise ValueError(f"{self.rule_id}: a match need not hold one of {self.needles}")

    @property
    def must_hold(self) -> tuple[str, ...]:
        """The needles given, or those that the pattern shows."""
        return self.needles or sure_needles(self.pattern)

    @property
    def category(self) -> str:
        for prefix, category in CATEGORY_BY_PREFIX.items():
            if self.rule_id.startswith(prefix):
                return category
        return "maintainability"


CATEGORY_BY_PREFIX = {"SEC": "security", "PERF": "performance", "STYLE": "style"}

# The pattern rules, in scan order.
PATTERN_RULES = (
    PatternRule(
        rule_id="SEC001", severity="critical", fixable=True, needles=("eval",),
        pattern=r"\beval\s*\(",
        title="Dangerous eval() usage",
        message="eval() executes arbitrary code and is a major security risk. Use ast.literal_eval() for safe deserialization.",
        fix="Replace eval() with ast.literal_eval() for safe literal parsing:\n  import ast\n  result = ast.literal_eval(user_input)",
    ),
    PatternRule(
        rule_id="SEC002", severity="critical", needles=("exec",),
        pattern=r"\bexec\s*\(",
        title="Dangerous exec() usage",
        message="exec() runs arbitrary Python code. Avoid unless absolutely necessary.",
    ),
    PatternRule(
        rule_id="SEC003", severity="critical", fixable=True, needles=("subprocess.",),
        pattern=r"subprocess\.(call|run|Popen).*shell\s*=\s*True",
        title="Shell injection risk",
        message="shell=True with subprocess passes input to a shell, enabling command injection. Use a list of arguments instead.",
        fix="Use list form:\n  subprocess.run(['ls', '-la'], shell=False)  # Safe",
    ),
    PatternRule(
        rule_id="SEC004", severity="error", fixable=True, needles=("os.system(",),
        pattern=r"os\.system\(",
        title="os.system() — shell injection risk",
        message="os.system() is vulnerable to shell injection. Use subprocess.run() with a list.",
        fix="Replace with:\n  import subprocess\n  subprocess.run(['command', 'arg1'], check=True)",
    ),
    PatternRule(
        rule_id="SEC005", severity="error", needles=("pickle.",),
        pattern=r"pickle\.(load|loads|dump|dumps)",
        title="Insecure pickle deserialization",
        message="pickle can execute arbitrary code during deserialization. Never unpickle untrusted data.",
    ),
    PatternRule(
        rule_id="SEC006", severity="warning", fixable=True, needles=("hashlib.md5",),
        pattern=r"hashlib\.md5\s*\(",
        title="Weak MD5 hash",
        message="MD5 is cryptographically broken. Use hashlib.sha256() or better.",
        fix="Replace MD5 with SHA-256:\n  hashlib.sha256(data).hexdigest()",
    ),
    PatternRule(
        rule_id="SEC007", severity="warning", fixable=True, needles=("hashlib.sha1",),
        pattern=r"hashlib\.sha1\s*\(",
        title="Weak SHA-1 hash",
        message="SHA-1 is deprecated for security use. Use hashlib.sha256() or hashlib.sha3_256().",
        fix="Replace SHA-1:\n  hashlib.sha256(data).hexdigest()",
    ),
    PatternRule(
        rule_id="SEC008", severity="critical", fixable=True, needles=("password",),
        pattern=r"""password\s*=\s*['"][^'"]+['"]""",
        title="Hardcoded password",
        message="Hardcoded credentials are a severe security vulnerability. Use environment variables.",
        fix="Use environment variables:\n  import os\n  password = os.environ.get('DB_PASSWORD')",
    ),
    PatternRule(
        rule_id="SEC009", severity="critical", fixable=True, needles=("secret",),
        pattern=r"""secret\s*=\s*['"][^'"]+['"]""",
        title="Hardcoded secret",
        message="Hardcoded secrets should be stored in environment variables or a secrets manager.",
        fix="Use os.environ.get('SECRET_KEY') or a secrets manager like python-dotenv",
    ),
    PatternRule(
        rule_id="SEC010", severity="critical", fixable=True, needles=("api_key",),
        pattern=r"""api_key\s*=\s*['"][^'"]+['"]""",
        title="Hardcoded API key",
        message="API keys in source code will be exposed in version control.",
        fix="Use:\n  api_key = os.environ.get('API_KEY')",
    ),
    PatternRule(
        rule_id="SEC011", severity="critical", fixable=True,
        needles=("select", "insert", "update", "delete"),
        pattern=r"""['"]SELECT\s.*WHERE.*['"].*\+|['"]INSERT\s.*VALUES.*['"].*\+|['"]UPDATE\s.*SET.*['"].*\+|['"]DELETE\s.*WHERE.*['"].*\+|SELECT.*%s|SELECT.*format\(""",
        title="Potential SQL injection",
        message="String formatting in SQL queries enables injection attacks. Use parameterized queries.",
        fix="Use parameterized queries:\n  cursor.execute('SELECT * FROM users WHERE id = ?', (user_id,))",
    ),
    PatternRule(
        rule_id="SEC012", severity="info", fixable=True, needles=("random.",),
        pattern=r"random\.(random|randint|choice)\s*\(",
        title="Non-cryptographic random",
        message="random module is not cryptographically secure. For security tokens use secrets module.",
        fix="For security use:\n  import secrets\n  token = secrets.token_hex(32)",
    ),
    PatternRule(
        rule_id="PERF001", severity="warning", fixable=True, needles=("range(len(",),
        pattern=r"for\s+\w+\s+in\s+range\(len\(",
        title="Use enumerate() instead of range(len())",
        message="range(len(x)) is Pythonic anti-pattern. Use enumerate() for index+value access.",
        fix="Replace:\n  for i, item in enumerate(my_list):  # Pythonic!",
    ),
    PatternRule(
        rule_id="PERF002", severity="warning", fixable=True, needles=("+",),
        pattern=r"""\+\s*=\s*['"]|['"].*\+\s*=""",
        title="String concatenation in loop",
        message="String concatenation with += in loops is O(n²). Use list and str.join() instead.",
        fix="Use list join:\n  parts = []\n  for item in items:\n      parts.append(str(item))\n  result = ''.join(parts)",
    ),
    PatternRule(
        rule_id="PERF003", severity="info", needles=(".append(",),
        pattern=r"\.append\(.*\)\s*\n.*\.append\(",
        title="Consider list comprehension",
        message="Sequential appends can often be replaced with a faster, more readable list comprehension.",
    ),
    PatternRule(
        rule_id="PERF004", severity="info", fixable=True, needles=("time.sleep(0)",),
        pattern=r"time\.sleep\(0\)",
        title="sleep(0) yields control unnecessarily",
        message="time.sleep(0) is a no-op in most contexts. Remove it or use asyncio.sleep(0) in async code.",
        fix="In async code:\n  await asyncio.sleep(0)  # Yield to event loop",
    ),
    PatternRule(
        rule_id="PERF005", severity="warning", needles=("global",),
        pattern=r"global\s+\w+",
        title="Global variable usage",
        message="Global variables prevent optimization and make code hard to test. Consider class attributes or parameters.",
    ),
    PatternRule(
        rule_id="PERF006", severity="warning", fixable=True, needles=("import *",),
        pattern=r"import \*",
        title="Wildcard import",
        message="Wildcard imports pollute namespace, hide dependencies, and prevent static analysis.",
        fix="Explicitly import:\n  from module import ClassA, function_b",
    ),
    PatternRule(
        rule_id="STYLE001", severity="error", fixable=True, needles=("except",),
        pattern=r"except\s*:",
        title="Bare except clause",
        message="Bare 'except:' catches ALL exceptions including KeyboardInterrupt and SystemExit. Catch specific exceptions.",
        fix="Specify exception type:\n  except ValueError as e:\n      logger.error(f'Value error: {e}')",
    ),
    PatternRule(
        rule_id="STYLE002", severity="warning", fixable=True, needles=("except",),
        pattern=r"except\s+Exception\s*:",
        title="Overly broad Exception catch",
        message="Catching all Exceptions hides bugs. Catch specific exception types.",
        fix="Catch specific exceptions:\n  except (ValueError, TypeError) as e:\n      handle(e)",
    ),
    PatternRule(
        rule_id="STYLE003", severity="info", fixable=True, needles=("pass",),
        pattern=r"pass\s*$",
        title="Empty block with pass",
        message="Empty blocks with just 'pass' may indicate incomplete implementation. Add a comment or raise NotImplementedError.",
        fix="Add context:\n  raise NotImplementedError('TODO: implement this')\n  # or\n  ...  # Intentionally empty",
    ),
    PatternRule(
        rule_id="STYLE004", severity="info", fixable=True, needles=("print",),
        pattern=r"print\s*\(",
        title="print() statement",
        message="Use logging instead of print() for production code. print() has no log levels or output control.",
        fix="Replace with logging:\n  import logging\n  logger = logging.getLogger(__name__)\n  logger.info('message')",
    ),
    PatternRule(
        rule_id="STYLE005", severity="info", needles=("todo", "fixme", "hack", "xxx"),
        pattern=r"#\s*TODO|#\s*FIXME|#\s*HACK|#\s*XXX",
        title="TODO/FIXME comment",
        message="Unresolved TODO/FIXME comments indicate incomplete or problematic code.",
    ),
    PatternRule(
        rule_id="STYLE006", severity="info", fixable=True, needles=("==",),
        pattern=r"==\s*True|==\s*False",
        title="Explicit boolean comparison",
        message="Comparing to True/False explicitly is un-Pythonic. Use truthiness directly.",
        fix="Write:\n  if is_valid:  # Not: if is_valid == True\n  if not is_empty:  # Not: if is_empty == False",
    ),
    PatternRule(
        rule_id="STYLE007", severity="info", fixable=True, needles=("==",),
        pattern=r"is\s+not\s+None\s+==|==\s+None",
        title="Use 'is None' for None check",
        message="Use 'is None' and 'is not None' for None comparisons, not == None.",
        fix="Write:\n  if value is None:  # Correct\n  if value is not None:  # Correct",
    ),
    PatternRule(
        rule_id="MAINT001", severity="warning", fixable=True, needles=("def",),
        pattern=r"def\s+\w+\([^)]{80,}\)",
        title="Too many function parameters",
        message="Functions with many parameters are hard to use and test. Consider using a dataclass or config object.",
        fix="Refactor:\n  @dataclass\n  class Config:\n      param1: str\n      param2: int\n  \n  def my_func(config: Config): ...",
    ),
    PatternRule(
        rule_id="MAINT002", severity="warning", needles=("lambda",),
        pattern=r"lambda\s+\w+.*lambda\s+\w+",
        title="Nested lambda",
        message="Nested lambdas are difficult to read and debug. Extract to named functions.",
    ),
    PatternRule(
        rule_id="MAINT003", severity="info", needles=("ignore",),
        pattern=r"#\s*type:\s*ignore",
        title="Type ignore comment",
        message="# type: ignore suppresses type checking. Fix the underlying type issue instead.",
    ),
    PatternRule(
        rule_id="MAINT004", severity="info", needles=("noqa",),
        pattern=r"noqa",
        title="noqa — suppressed lint",
        message="noqa comments suppress linting. Each should have a specific code (e.g., # noqa: E501) and justification.",
    ),
)

# Badges and the author metric each one asks for.
BADGES = (
    {"slug": "first-review", "name": "First Review", "metric": "reviews", "threshold": 1.0,
     "description": "Completed your first code review."},
    {"slug": "code-guardian", "name": "Code Guardian", "metric": "reviews", "threshold": 10.0,
     "description": "Completed 10 code reviews."},
    {"slug": "security-hawk", "name": "Security Hawk", "metric": "critical_found", "threshold": 5.0,
     "description": "Found 5 critical security issues."},
    {"slug": "clean-coder", "name": "Clean Coder", "metric": "quality_score", "threshold": 90.0,
     "description": "Achieved a quality score of 90+ on a review."},
    {"slug": "refactor-king", "name": "Refactor King", "metric": "issues_fixed", "threshold": 20.0,
     "description": "Fixed 20 issues across all reviews."},
    {"slug": "streak-3", "name": "On a Roll", "metric": "streak_days", "threshold": 3.0,
     "description": "Reviewed code 3 days in a row."},
)


def rules_frame(spark: SparkSession, rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """The rule dimension; as many rows as rules."""
    return spark.createDataFrame(pa.table({
        "rule_id": [r.rule_id for r in rules],
        "severity": [r.severity for r in rules],
        "category": [r.category for r in rules],
        "title": [r.title for r in rules],
        "message": [r.message for r in rules],
        "is_fixable": [r.fixable for r in rules],
        "fix_description": pa.array([r.fix for r in rules], pa.string()),
    }))


def severity_frame(spark: SparkSession) -> DataFrame:
    """The severity dimension: four rows, rank 4 the most serious."""
    return spark.createDataFrame(pa.table({
        "severity": list(SEVERITIES),
        "severity_rank": pa.array(range(len(SEVERITIES), 0, -1), pa.int32()),
    }))


def badges_frame(spark: SparkSession) -> DataFrame:
    """The badge dimension: six rows, numbered from 1, criteria as a metric-to-threshold map."""
    return spark.createDataFrame(pa.table({
        "badge_id": pa.array(range(1, len(BADGES) + 1), pa.int64()),
        "slug": [b["slug"] for b in BADGES],
        "name": [b["name"] for b in BADGES],
        "description": [b["description"] for b in BADGES],
        "criteria": pa.array([[(b["metric"], b["threshold"])] for b in BADGES],
                             pa.map_(pa.string(), pa.float64())),
    }))
