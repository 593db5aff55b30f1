"""Fixed values the results depend on.

Everything here is data, not logic: log markers written by the build tool and
the shuffling test runner, annotation names of the test framework, delimiters a
model is asked to use, and file-layout conventions.  Every operator takes these
as parameters, so another tool chain only needs another set of values.
"""

from __future__ import annotations

# --- fixed values: verdicts of one run ------------------------------------
FAILURE = "FAILURE"
PASS = "PASS"
COMPILATION_ERROR = "COMPILATION_ERROR"
UNRECOGNIZED = "UNRECOGNIZED"

# A rule is (verdict, markers); it holds when the log contains all markers.
# The first rule that holds decides.
VERDICT_RULES = (
    (FAILURE, ("There are test failures",)),
    (PASS, ("BUILD SUCCESS", "No Test Failed with this configuration")),
    (COMPILATION_ERROR, ("BUILD FAILURE", "COMPILATION ERROR")),
)

# --- fixed values: log lines ----------------------------------------------
ERROR_PREFIX = "[ERROR]"
ERROR_NOISE = ("Time elapsed", "There are test failures", "Skipped:", "Failed to execute goal")
GOAL_FAILED = "Failed to execute goal"
COMPILE_MARKER = "COMPILATION ERROR"
REGION_START = "[INFO] Finished at:"
REGION_END = "To see the full stack trace of the errors"
REGION_NOISE = "-> [Help 1]"
FRAME_PREFIX = "\tat "
REPORT_DIR_START = "Please refer to"
REPORT_DIR_END = "for the individual test results"
BUILD_MARKER = "BUILD "

# --- fixed values: reports and file layout --------------------------------
REPORT_NAME_PREFIX = "TEST-"
REPORT_SUFFIX = ".xml"
SOURCE_SUFFIX = ".java"
TEST_DIR = "/test/"
SOURCE_ROOT = "/src/"
BUILD_FILE = "pom.xml"

# --- fixed values: lifecycle annotations ----------------------------------
BEFORE_ANNOTATIONS = ("BeforeClass", "Before", "BeforeAll", "BeforeEach")
AFTER_ANNOTATIONS = ("AfterClass", "After", "AfterAll", "AfterEach")
LIFECYCLE_ANNOTATIONS = BEFORE_ANNOTATIONS + AFTER_ANNOTATIONS

# --- fixed values: model responses ----------------------------------------
FIX_START = "//<fix start>"
FIX_END = "//<fix end>"
IMPORT_START = "//<import start>"
IMPORT_END = "//<import end>"
FENCES = ("```java", "```", FIX_START, FIX_END)
# (start, end) in order of precedence
BUILD_BLOCK_RULES = (
    ("<!-- <pom.xml start> -->", "<!-- <pom.xml end> -->"),
    ("<pom.xml start>", "<!-- <pom.xml end>"),
    ("```xml", "```"),
)
IMPORT_PATTERN = r"import\s+(static\s+)?([\w\.]+(\.\*)?);"
DEPENDENCY_WRAPPERS = ("<dependencies>", "</dependencies>")
DEPENDENCIES_ANCHOR = "<dependencies>"
PLACEHOLDER_ARTIFACTS = ("mycompany", "artifact")

# --- fixed values: JDK choice ---------------------------------------------
JDK_LINE_PATTERN = "<jdk.*>"
# contained in the matching build-file lines -> JDK, in order of precedence
JDK_TEXT_RULES = (("11", "11"), ("8", "8"))
JDK_BY_URL = {"https://github.com/INRIA/spoon": "11"}
JDK_BY_PROJECT = {"cloudstack": "11"}
JDK_DEFAULT = "8"

# --- fixed values: repair loop --------------------------------------------
MAX_ATTEMPTS = 5
LOCALIZED = "ok"
NOT_LOCALIZED = "failure to localize"
AMBIGUOUS = "ambiguous"
SKIPPED = "skipped"
FIXED = "fixed"
UNRESOLVED = "unresolved"
