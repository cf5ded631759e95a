"""Symbol patterns by language, file extensions, comment openers.

Each pattern is matched from the start of a stripped line; group 1 is the symbol's label.
Order matters: the first pattern that matches decides the kind.
"""

JAVASCRIPT = [
    ("function", r"^(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s+(\w+)\s*[\(<]"),
    ("class", r"^(?:export\s+(?:default\s+)?)?class\s+(\w+)"),
    ("function", r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\("),
]

# language -> (extensions, [(kind, pattern)])
SYMBOL_RULES = {
    "javascript": ([".js", ".jsx", ".mjs", ".cjs"], JAVASCRIPT),
    "typescript": ([".ts", ".tsx", ".cts", ".mts"], JAVASCRIPT + [
        ("interface", r"^(?:export\s+)?(?:default\s+)?interface\s+(\w+)"),
        ("type", r"^(?:export\s+)?type\s+(\w+)\s*(?:<[^=]+>)?\s*="),
        ("enum", r"^(?:export\s+)?(?:const\s+)?enum\s+(\w+)"),
        ("decorator", r"^@(\w+)\s*(?:\(|$)"),
    ]),
    "rust": ([".rs"], [
        ("function", r"^(?:pub\s+(?:\(\w+\)\s+)?)?(?:async\s+)?fn\s+(\w+)\s*[\(<]"),
        ("struct", r"^(?:pub\s+)?struct\s+(\w+)"),
        ("enum", r"^(?:pub\s+)?enum\s+(\w+)"),
        ("trait", r"^(?:pub\s+)?trait\s+(\w+)"),
        ("impl", r"^impl(?:\s*<[^>]*>)?\s+(?:\w+\s+for\s+)?(\w+)"),
        ("module", r"^(?:pub\s+)?mod\s+(\w+)\s*\{"),
        ("type", r"^(?:pub\s+)?type\s+(\w+)\s*="),
        ("macro", r"^(?:pub\s+)?macro_rules!\s*(\w+)"),
    ]),
    "go": ([".go"], [
        ("function", r"^func\s+(?:\([^)]+\)\s+)?(\w+)\s*[\(<]"),
        ("struct", r"^type\s+(\w+)\s+struct"),
        ("interface", r"^type\s+(\w+)\s+interface"),
        ("type", r"^type\s+(\w+)\s+\w"),
        ("variable", r"^(?:var|const)\s+(\w+)\s"),
    ]),
    "java": ([".java"], [
        ("class", r"^(?:public\s+|private\s+|protected\s+|static\s+)*(?:abstract\s+|final\s+)?class\s+(\w+)"),
        ("interface", r"^(?:public\s+|private\s+|protected\s+)?interface\s+(\w+)"),
        ("enum", r"^(?:public\s+|private\s+|protected\s+)?enum\s+(\w+)"),
        ("annotation", r"^(?:public\s+)?@interface\s+(\w+)"),
    ]),
    "csharp": ([".cs"], [
        ("namespace", r"^namespace\s+([\w.]+)"),
        ("class", r"^(?:(?:public|private|protected|internal|abstract|sealed|partial|static)\s+)*class\s+(\w+)"),
        ("interface", r"^(?:(?:public|private|protected|internal)\s+)*interface\s+(\w+)"),
        ("enum", r"^(?:(?:public|private|protected|internal)\s+)*enum\s+(\w+)"),
        ("struct", r"^(?:(?:public|private|protected|internal|readonly)\s+)*struct\s+(\w+)"),
        ("record", r"^(?:(?:public|private|protected|internal)\s+)*record\s+(\w+)"),
    ]),
    "kotlin": ([".kt", ".kts"], [
        ("class", r"^(?:(?:data|sealed|abstract|open|inner|enum)\s+)*(?:class|object)\s+(\w+)"),
        ("interface", r"^(?:fun\s+)?interface\s+(\w+)"),
        ("function", r"^(?:(?:public|private|protected|internal|suspend|inline|override|abstract|open)\s+)*fun\s+(?:<[^>]+>\s+)?(\w+)\s*[\(<]"),
        ("type", r"^typealias\s+(\w+)\s*="),
    ]),
    "swift": ([".swift"], [
        ("class", r"^(?:(?:public|private|internal|open|final)\s+)?class\s+(\w+)"),
        ("struct", r"^(?:(?:public|private|internal)\s+)?struct\s+(\w+)"),
        ("protocol", r"^(?:(?:public|private|internal)\s+)?protocol\s+(\w+)"),
        ("enum", r"^(?:(?:public|private|internal|indirect)\s+)?enum\s+(\w+)"),
        ("function", r"^(?:(?:public|private|internal|static|class|override|mutating|open)\s+)*func\s+(\w+)\s*[\(<]"),
        ("extension", r"^extension\s+(\w+)"),
    ]),
    "ruby": ([".rb"], [
        ("module", r"^module\s+(\w+)"),
        ("class", r"^class\s+(\w+)"),
        ("function", r"^def\s+(\w+)"),
    ]),
    "php": ([".php"], [
        ("class", r"^(?:abstract\s+|final\s+)?class\s+(\w+)"),
        ("interface", r"^interface\s+(\w+)"),
        ("trait", r"^trait\s+(\w+)"),
        ("enum", r"^enum\s+(\w+)"),
        ("function", r"^(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+(\w+)\s*\("),
    ]),
    "scala": ([".scala"], [
        ("class", r"^(?:case\s+)?class\s+(\w+)"),
        ("object", r"^(?:case\s+)?object\s+(\w+)"),
        ("trait", r"^trait\s+(\w+)"),
        ("function", r"^(?:(?:private|protected|override|implicit|inline|def)\s+)*def\s+(\w+)\s*[\[(]"),
        ("type", r"^type\s+(\w+)\s*="),
    ]),
    "shell": ([".sh", ".bash"], [
        ("function", r"^(\w+)\s*\(\s*\)"),
        ("function", r"^function\s+(\w+)\s*(?:\(|\{|$)"),
    ]),
    "lua": ([".lua"], [
        ("function", r"^(?:local\s+)?function\s+([\w.:]+)\s*\("),
        ("function", r"^([\w.]+)\s*=\s*function\s*\("),
    ]),
    "assembly": ([".asm", ".s"], [
        ("label", r"^(\.[a-zA-Z_]\w*|[a-zA-Z_]\w*):"),
        ("section", r"^\.(text|data|bss|rodata|section)\b"),
    ]),
    "sql": ([".sql"], [
        ("table", r"(?i)^CREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)"),
        ("view", r"(?i)^CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+(\w+)"),
        ("function", r"(?i)^CREATE\s+(?:OR\s+REPLACE\s+)?FUNCTION\s+(\w+)"),
        ("procedure", r"(?i)^CREATE\s+(?:OR\s+REPLACE\s+)?PROCEDURE\s+(\w+)"),
        ("index", r"(?i)^CREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)"),
    ]),
    "markdown": ([".md", ".mdx"], [
        ("heading", r"^#{1,6}\s+(.+?)\s*$"),
    ]),
    "html": ([".html", ".htm", ".xhtml"], [
        ("anchor", r'^<\w+[^>]*\sid="([^"]+)"'),
        ("component", r"^<([a-z][\w-]+-[\w-]+)(?:\s|>|/)"),
    ]),
    "css": ([".css", ".scss", ".sass", ".less"], [
        ("class", r"^\.([\w-]+)\s*(?:\{|,|:)"),
        ("id", r"^#([\w-]+)\s*(?:\{|,|:)"),
        ("keyframes", r"^@keyframes\s+([\w-]+)"),
        ("mixin", r"^@mixin\s+([\w-]+)"),
        ("function", r"^@function\s+([\w-]+)"),
    ]),
    "dockerfile": ([".dockerfile"], [
        ("arg", r"(?i)^ARG\s+([\w]+)"),
        ("env", r"(?i)^ENV\s+([\w]+)"),
        ("stage", r"(?i)^FROM\s+\S+\s+AS\s+([\w-]+)"),
    ]),
    "toml": ([".toml"], [
        ("section", r"^\[([^\[\]]+)\]$"),
        ("array_section", r"^\[\[([^\[\]]+)\]\]$"),
    ]),
}

# Languages whose symbols come from a grammar or from an input table instead of patterns.
OTHER_EXTENSIONS = {
    "python": [".py"],
    "c": [".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hxx"],
}

# Openers that end the inspection of a line, whatever the language.
COMMENT_OPENERS = ["#", "//", "/*", "*", "--"]

# The same by language, for callers who want Markdown headings and CSS ids found.
SLASH = ["//", "/*", "*"]
COMMENT_OPENERS_BY_LANGUAGE = {
    "ruby": ["#"], "shell": ["#"], "dockerfile": ["#"], "toml": ["#"],
    "assembly": ["#", "//", "/*"],
    "sql": ["--", "/*", "*"], "lua": ["--"],
    "markdown": [], "html": ["<!--"], "css": ["/*", "*"],
    "php": ["#", "//", "/*", "*"],
}

DEFAULT_EXCLUDED_DIRS = [
    ".git", ".venv", "venv", "__pycache__", "node_modules", ".pytest_cache", ".mypy_cache", "dist",
    "build", ".eggs", "*.egg-info", ".vs", ".idea", ".vscode", "bin", "obj",
]

PLATFORM_FRAGMENTS = [
    "apple", "darwin", "macos", "solaris", "aix", "hpux", "irix", "sunos",
    "win32", "mingw", "msvc", "winnt", "os400", "vms", "nonstop", "vcbuild",
]

MODE_DEPTH = {"directory": 1, "ast": 2, "dependencies": 2}
