"""Fixed values of the data model: languages, file names and lists by which files are taken or left."""

from __future__ import annotations

# Language of a file by its exact name.
FILENAME_LANGUAGES = {
    "Dockerfile": "dockerfile", "dockerfile": "dockerfile", "Makefile": "make", "makefile": "make", "GNUmakefile": "make",
    "CMakeLists.txt": "cmake", "Jenkinsfile": "groovy", "Vagrantfile": "ruby", "Rakefile": "ruby", "Gemfile": "ruby", "Podfile": "ruby",
    "Brewfile": "ruby", "BUILD": "starlark", "BUILD.bazel": "starlark", "WORKSPACE": "starlark", "WORKSPACE.bazel": "starlark",
    ".gitignore": "gitignore", ".dockerignore": "gitignore", ".prettierrc": "json", ".eslintrc": "json", ".babelrc": "json",
    "tsconfig.json": "json", "package.json": "json", "composer.json": "json", "Cargo.toml": "toml", "pyproject.toml": "toml",
    "go.mod": "gomod", "go.sum": "gosum", ".editorconfig": "ini", "requirements.txt": "requirements", "Pipfile": "toml",
}

# Extensions of each language, lower case.
LANGUAGE_EXTENSIONS = {
    "python": ".py", "javascript": ".js .jsx", "typescript": ".ts", "tsx": ".tsx", "rust": ".rs", "go": ".go", "java": ".java",
    "c": ".c .h", "cpp": ".cpp .cc .cxx .hpp", "ruby": ".rb", "php": ".php", "css": ".css .less", "scss": ".scss .sass",
    "html": ".html .htm", "vue": ".vue", "svelte": ".svelte", "astro": ".astro", "yaml": ".yaml .yml", "json": ".json", "toml": ".toml",
    "csv": ".csv", "tsv": ".tsv", "sql": ".sql", "graphql": ".graphql .gql", "prisma": ".prisma", "proto": ".proto",
    "bash": ".sh .bash .zsh", "markdown": ".md .mdx", "rst": ".rst", "scala": ".scala", "kotlin": ".kt .kts", "swift": ".swift",
    "objc": ".m .mm", "c_sharp": ".cs", "ocaml": ".fs .ml .mli", "elixir": ".ex .exs", "erlang": ".erl .hrl", "haskell": ".hs",
    "lua": ".lua", "r": ".r", "julia": ".jl", "perl": ".pl .pm", "clojure": ".clj .cljs .cljc", "dart": ".dart", "elm": ".elm",
    "hcl": ".hcl .tf", "zig": ".zig", "nim": ".nim", "v": ".v", "d": ".d", "ada": ".ada .adb .ads", "pascal": ".pas .pp",
    "fortran": ".f90 .f95 .f03", "cobol": ".cob .cbl", "commonlisp": ".lisp .cl", "reason": ".re .rei",
}
EXTENSION_LANGUAGES = {e: lang for lang, exts in LANGUAGE_EXTENSIONS.items() for e in exts.split()}

# Languages with structural extraction, in registry order, and the extensions that import resolution tries.
STRUCTURAL = ["typescript", "tsx", "javascript", "python", "go", "rust", "java", "c_sharp", "kotlin", "scala", "dart", "swift", "php", "ruby", "c", "cpp", "vue", "svelte", "astro"]
RESOLVE_EXTENSIONS = ".ts .tsx .js .jsx .py .go .rs .java .cs .kt .kts .scala .dart .swift .php .rb .c .h .cpp .hpp .cc .cxx .vue .svelte .astro".split()
INDEX_FILES = "index.ts index.tsx index.js index.jsx __init__.py index.vue".split()
JS_FAMILY = ["typescript", "tsx", "javascript", "vue", "svelte", "astro"]
SCRIPT_MODES = ["vue", "svelte", "astro"]
ALIAS_CONFIG_FILES = ["jsconfig.json", "tsconfig.base.json", "tsconfig.json"]
DEFAULT_ALIASES = {"@/": "src/", "~/": "src/"}

# Languages whose files become vertices without elements.
PASSTHROUGH = "bash cmake css csv dockerfile gitignore gomod gosum graphql html ini json make markdown prisma proto requirements rst scss sql starlark toml tsv yaml".split()

# Extensions of files that are never read.
BLOCKED_EXTENSIONS = set("""
    .exe .dll .so .dylib .a .lib .pyc .pyo .pyd __pycache__ .class .jar .war .ear .o .obj .ko .wasm .beam .rlib
    .png .jpg .jpeg .gif .bmp .ico .webp .svg .tiff .tif .psd .ai .eps .heic .heif .raw .cr2 .nef
    .ttf .otf .woff .woff2 .eot .fon
    .mp4 .mp3 .wav .avi .mov .mkv .flv .wmv .webm .m4a .m4v .aac .ogg .flac .3gp .mpeg .mpg
    .zip .tar .gz .bz2 .xz .7z .rar .tgz .tbz2 .lz .lzma .cab .iso
    .db .sqlite .sqlite3 .mdb .accdb .parquet .avro .orc .pickle .pkl .npy .npz .h5 .hdf5 .feather .arrow""".split())
# Lock files.
LOCK_FILES = """package-lock.json yarn.lock pnpm-lock.yaml Cargo.lock Gemfile.lock poetry.lock Pipfile.lock composer.lock mix.lock
    pubspec.lock packages.lock.json paket.lock shrinkwrap.yaml bun.lockb""".split()
# Patterns of generated files.
GENERATED = "*.min.js *.min.css *.bundle.js *.chunk.js *.map *.generated.* *.auto.* *-lock.* *.snap *.pb.go *.pb.ts *_pb2.py *_pb2_grpc.py *.g.dart *.freezed.dart".split()
# Hidden files that are read all the same.
ALLOWED_HIDDEN = """.gitignore .gitattributes .editorconfig .prettierrc .prettierrc.json .prettierrc.yaml .prettierrc.yml .eslintrc .eslintrc.json
    .eslintrc.yaml .eslintrc.yml .eslintrc.js .babelrc .babelrc.json .env.example .env.sample .dockerignore .npmrc .yarnrc .nvmrc
    .python-version .ruby-version .node-version .tool-versions""".split()
# Folders that are not entered, beside all that begin with a dot.
BLOCKED_FOLDERS = set("""
    node_modules vendor bower_components __pycache__ venv env site-packages pip-wheel-metadata dist build out output target _build
    coverage htmlcov tmp temp _site migrations migrate alembic __snapshots__ fixtures testdata test_data generated __generated__ codegen
    locales i18n translations logs""".split())

MAX_FILE_BYTES, MAX_FILES = 2_000_000, 40_000
MAX_CHARS, MAX_LINES, MINIFIED_LINES, MINIFIED_WIDTH = 2_000_000, 40_000, 100, 500
