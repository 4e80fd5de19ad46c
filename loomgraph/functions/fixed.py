"""Lists, labels and patterns that results must agree on.  Data only."""

from __future__ import annotations

import builtins
import sys

# C++ elements.
STD_TRANSPARENT = ("vector", "unordered_map", "unique_ptr", "array", "shared_ptr", "weak_ptr", "map", "set", "unordered_set", "list", "deque", "pair", "tuple", "optional", "initializer_list")
CPP_PRIMITIVES = (
    "void", "bool", "char", "signed char", "unsigned char", "wchar_t", "char8_t", "char16_t", "char32_t", "short", "int", "long", "long long", "float", "double", "long double",
    "size_t", "ptrdiff_t", "nullptr_t", "unsigned", "unsigned int", "unsigned short", "unsigned long", "unsigned long long",
)
GENERATED_MARKERS = ("/build/", "/vcpkg_installed/", "autogen", "/cmake-build", "/.venv/")
NEVER_FIRST_PARTY_NS = ("std", "__gnu_cxx", "__cxxabiv1")
STD_LABEL, OTHER_LABEL = "(STL) std", "(기타)"

# C# types.
CS_TRANSPARENT = (
    "System.Collections.Generic.List`1", "System.Collections.Generic.Dictionary`2", "System.Collections.Generic.HashSet`1", "System.Collections.Generic.Queue`1",
    "System.Collections.Generic.Stack`1", "System.Collections.Generic.LinkedList`1", "System.Nullable`1", "[]",
    "System.ValueTuple`1", "System.ValueTuple`2", "System.ValueTuple`3", "System.ValueTuple`4", "System.ValueTuple`5", "System.ValueTuple`6", "System.ValueTuple`7", "System.ValueTuple`8",
)
CS_BASE_TYPES = (
    "System.Object", "System.ValueType", "System.Enum", "System.Void", "System.String", "System.Boolean", "System.Char", "System.Decimal", "System.Single", "System.Double",
    "System.SByte", "System.Byte", "System.Int16", "System.UInt16", "System.Int32", "System.UInt32", "System.Int64", "System.UInt64", "System.IntPtr", "System.UIntPtr",
)
CS_KIND = {"inherit": "inheritance", "realize": "realization", "assoc": "association", "depend": "dependency"}
CS_EDITOR, CS_ENGINE, CS_BCL, CS_VENDORED, CS_MODULE = "(엔진 에디터) UnityEditor", "(엔진) ", "(BCL) netstandard", "(벤더링) ", "com.unity.modules."

# Python types.
PY_BASE_TYPES = ("str", "int", "float", "bool", "bytes", "bytearray", "complex", "None", "NoneType", "object", "type", "...", "Any", "typing.Any", "typing.Generic", "typing.Protocol")
PY_TRANSPARENT = ("list", "dict", "set", "frozenset", "tuple", "typing.List", "typing.Dict", "typing.Set", "typing.FrozenSet", "typing.Tuple", "typing.Optional", "typing.Union")
PY_KIND = {"base": "inheritance", "attr": "association", "sig": "dependency"}
PY_TYPEVAR_CALLS = ("TypeVar", "ParamSpec", "TypeVarTuple")
PY_CLASS_CALLS = ("TypedDict", "NamedTuple")
PY_STDLIB = "(표준) stdlib"
CALL_LABEL = "호출"
#: Names of the standard library and of its built-ins, as the interpreter lists them.
STDLIB = tuple(sorted(sys.stdlib_module_names))
BUILTINS = tuple(sorted(dir(builtins)))

# Reasons of drops and their classes.
DROP_CLASS = {
    "R7 원시 타입 제외": "policy", "R7 원시 타입 버림": "policy", "R7 원시·암묵 기반 버림": "policy", "R5 투과 래퍼": "policy", "R5 투과 래퍼 경유": "policy", "R5 투과 컨테이너 경유": "policy",
    "중복 간선 접음": "policy", "자기참조 버림": "policy", "R4 외부발 간선 버림": "policy", "R1 로 제거된 외부 노드": "policy", "containment 버림(자리 없음)": "policy", "clang-doc 1차 아님(버림)": "policy",
    "enum 멤버 버림(플래그)": "policy", "소스 제네릭 인스턴스 접음": "policy", "git 추적 밖 모듈": "policy", "호출이 기존 간선에 접힘": "policy", "dst TypeParameter 버림": "policy", "타입 변수": "policy", "빌트인": "policy",
    "dst Error 버림": "unresolved", "끝점 해소 실패": "unresolved", "호출 양끝 해소 실패": "unresolved", "식 깊이 초과": "unresolved", "이름이 아닌 식 버림": "unresolved", "이름 해소 실패": "unresolved", "1차 이름 꼬리 겹침": "unresolved",
    "모르는 관계 종류": "fault",
    "1차 노드": "count", "외부 원본 타입": "count", "모듈": "count", "모듈 간 의존": "count", "중첩 클래스": "count", "호출 간선": "count", "asm->pkg 사전": "count", "clang-doc 로 위치 갱신": "count", "pycalls 로 시그니처 보강": "count",
    "clang-doc 신규 노드": "count", "pycalls 신규 노드": "count", "형 별칭 펼침": "count", "1차 이름 꼬리 맞춤": "count", "함수 꼴 TypedDict 노드": "count",
}

# Codes of graph faults, their layers and sections.
LAYER = {
    "unreadable": "V0 읽기",
    "top-field": "V1 꼴", "schema-version": "V1 꼴", "language": "V1 꼴", "empty-graph": "V1 꼴", "node-shape": "V1 꼴", "edge-shape": "V1 꼴", "module-shape": "V1 꼴", "node-kind": "V1 꼴", "external-only": "V1 꼴", "occurrences-range": "V1 꼴",
    "duplicate-node": "V2 정합", "duplicate-edge": "V2 정합", "dangling-edge": "V2 정합", "external-node": "V2 정합", "external-source": "V2 정합", "external-constraint": "V2 정합", "first-party-location": "V2 정합", "module-list": "V2 정합", "module-dep": "V2 정합", "module-dep-mismatch": "V2 정합",
    "file-outside-repo": "V3 근거", "file-missing": "V3 근거", "line-out-of-range": "V3 근거", "freshness-unknown": "V3 근거", "generation-mismatch": "V3 근거", "source-drift": "V3 근거",
    "collect-failed": "수집",
    "report-stale": "V4 장부", "unknown-kind": "V4 장부", "unresolved-drop": "V4 장부",
    "inventory-stale": "범위", "language-not-collected": "범위", "coverage-gap": "범위",
}
SECTION_OF_LAYER = {"V0 읽기": "integrity", "V1 꼴": "integrity", "V2 정합": "integrity", "V3 근거": "freshness", "수집": "coverage", "V4 장부": "coverage", "범위": "coverage"}
REPORT_ONLY = ("language-not-collected", "coverage-gap")
NODE_KINDS = ("function", "method", "class", "struct", "enum", "interface", "delegate", "record", "external")
GRAPH_LANGUAGES = ("cpp", "csharp", "python")
EDGE_KINDS = ("inheritance", "realization", "composition", "aggregation", "association", "dependency", "friendship", "instantiation")
CAPABILITIES = {"python": (True, True, "heuristic"), "cpp": (False, False, "compiler"), "csharp": (False, False, "compiler")}

# Dictionary records.
NON_NODE_KINDS = ("file", "module", "artifact", "key", "concept")
TERM_KINDS = ("class", "struct", "enum", "interface", "delegate", "record", "external", "function") + NON_NODE_KINDS
TERM_EDGE_KINDS = ("inheritance", "realization", "composition", "aggregation", "association", "dependency")
# What a dictionary says of a module and of a node, and how many names it shows.
MODULE_MEANS = "타입 %d개를 묶은 모듈."
MODULE_NEEDS = " %s 모듈에 의존한다."
NODE_MEANS = "%s 모듈의 %s."
NODE_NEAR = " %s 와(과) 이어져 있다."
SHOWN_NAMES = 5
TERM_SOURCES = ("codegraph", "reading", "codegraph+reading")

# Languages of sources, their collectors, folders to leave out.
LANG_EXTS = {"cpp": (".cpp", ".cc", ".cxx", ".h", ".hpp", ".hxx"), "cs": (".cs",), "py": (".py",), "ts": (".ts", ".tsx")}
COLLECTOR = {"cpp": "clang-uml", "cs": "roslyn-dump", "py": "griffe+pycalls", "ts": "none"}
LANG_ALIAS = {"csharp": "cs", "python": "py"}
DOC_NAMES = ("README.md", "CLAUDE.md", "ARCHITECTURE.md", "AGENTS.md")
WALK_SKIPPED = (".git", "node_modules", "__pycache__", ".venv")
DECL_SKIPPED = ("node_modules", "__pycache__", ".git", "build", "obj", "bin", "vcpkg_installed", ".venv", "Library", "Temp", "out", ".tmp")
INDEX_SKIPPED = (".git", "Library", "Temp", "obj", "bin", "node_modules", "out")
INDEX_EXTS = ("cs", "h", "hpp", "cpp", "cc", "py", "mjs", "ts")
EXTERNAL_MARKERS = ("/vcpkg_installed/", "/_deps/", "/node_modules/", "/Qt/", "/homebrew/", "autogen", "/CMakeFiles/", "moc_", "qrc_", "ui_")

# How declarations and the comments above them look, by language: pattern, comment heads, what is cut off a comment.
DECLARATIONS = {
    "cs": (r"^\s*(?:\[[^\]]*\]\s*)?(?:public|internal|protected|private)?\s*(?:static\s+|abstract\s+|sealed\s+|partial\s+|readonly\s+)*(class|interface|struct|enum|record)\s+([A-Za-z_][\w<>,\s]*)", ("///",), r"^\s*///+\s?", r"<[^>]+>"),
    "cpp": (r"^\s*(?:template\s*<[^>]*>\s*)?(class|struct|enum class|enum|namespace)\s+([A-Za-z_]\w*)", ("///", "//!", "//"), r"^\s*//[/!]*\s?", None),
    "py": (r"^\s*(?:@\w+\s*)?(class|def)\s+([A-Za-z_]\w*)", ("#",), r"^\s*#+\s?", None),
    "ts": (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(class|interface|type|enum|function|const)\s+([A-Za-z_$][\w$]*)", ("///", "//", "*"), r"^\s*(?://+|\*+)\s?", None),
}
DECL_EXTS = {"cs": (".cs",), "cpp": (".h", ".hpp", ".cpp", ".cc"), "py": (".py",), "ts": (".ts", ".tsx", ".mjs", ".js", ".jsx")}

# Patterns of citations, terms and paths.
CITED = "h|hpp|hh|c|cc|cpp|cxx|mm|cs|py|mjs|js|ts|tsx|json|md|yaml|yml|toml|shader|glsl|dot"
CITE = rf"([A-Za-z0-9_@./+~-]+\.(?:{CITED})):(\d+)(?:-(\d+))?"
TERM_PATTERNS = (r"\b(?!D\d)[A-Z]{1,3}-?\d{1,3}\b", r"\b[a-z][a-z0-9_-]*\.json\b", r"\b[a-z][A-Za-z0-9_]*\[\]")
LINKED = "md|mjs|py|ts|tsx|json|css|html|dot|svg|yaml|yml|toml|cs|cpp|h"
PATH = rf"(?<![\w/.:-])((?:[\w.@-]+/)*(?:[\w.@-]+\.(?:{LINKED})|\*\.(?:{LINKED})))(?::(\d+(?:-\d+)?))?(?![\w/])"
LINK_SKIP_TAGS = ("script", "style", "svg", "summary", "h1", "h2", "h3", "th", "title", "a", "textarea")
LINK_SKIP_CLASSES = ("term-ref", "term-card", "term-groups", "term-graph", "svg-wrap")
TERM_SKIP_TAGS = ("script", "style", "svg", "code", "pre", "summary", "h1", "h2", "h3", "th", "title", "textarea")
TERM_SKIP_CLASSES = ("term-ref", "term-card", "mono", "term-groups", "term-graph", "svg-wrap")
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")

# Weights of files, stages of a run, their old names.
INTERFACE_WEIGHT, ABSTRACT_WEIGHT = 5, 3
STAGE_ORDER = (
    "lang-hint", "lang-decide", "detect-changes", "collect-graph", "verify-graph", "derive-facts", "schedule-batches", "annotate-symbols", "snapshot-sources", "verify-terms", "outline-wiki", "write-wiki", "publish-wiki", "verify-wiki", "seal-artifacts",
)
WARM_ONLY = ("detect-changes",)
RESTART_AT = {"verify-graph": "collect-graph"}
GRADE_STAGES, REPORT_STAGES = ("collect", "grade", "emit"), ("init", "agent", "build", "check")

# Folders of documents and the names of their files.
DOC_FOLDERS = (("specs", r"^(\d{4}-\d{2}-\d{2})-(.+)-design\.md$"), ("plans", r"^(\d{4}-\d{2}-\d{2})-(.+)\.md$"))
# Folders that are no Python root; the contract of a seal.
NO_ROOTS = ("out", "node_modules", ".venv", "__pycache__", "docs", "test")
SEAL_CONTRACT, SEAL_VERSION = "mode1-artifacts", 1

# Names of the buckets in a difference document.
DIFFERENCE_BUCKETS = {"unchanged": "유효", "reread": "재읽기", "location_only": "위치만", "deleted": "삭제됨"}
