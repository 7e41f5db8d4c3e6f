"""Table schemas as DDL; no reader infers them."""

DOCUMENT = "id LONG, file_name STRING, extension STRING, file_path STRING, md5 STRING, update_time TIMESTAMP, state STRING, request_type STRING, create_time TIMESTAMP, version INT"
PARAGRAPH = "para_id LONG, doc_id LONG, ord INT, content STRING, created TIMESTAMP"
POSTINGS = "term STRING, doc_id LONG, tf INT, positions ARRAY<INT>"
TASK = "id LONG, directory_path STRING, key_question STRING, covered_file_count INT, full_cost LONG, incremental_cost LONG, hit_count INT, status STRING, checkpoint LONG, error STRING"
FACT = "task_id LONG, para_id LONG, fact STRING, created TIMESTAMP"
CONFIG = "config_key STRING, config_value STRING, updated_at TIMESTAMP"
DIRECTORY = "directory_path STRING, index_status STRING, submit_time TIMESTAMP, completion_time TIMESTAMP"

#: Document states.
SAVED, INDEXED, ERROR, DELETED, IGNORED = "file_saved", "file_indexed", "error", "deleted", "ignored"
#: Directory states.
PENDING, COMPLETED, IGNORE_TRIGGERED = "pending", "completed", "ignore_triggered"

# Formats by extension, file types by format, and default settings.
#: Extensions that no format lists are `other`.
FORMATS = {
    "pdf": "pdf pdfa".split(),
    "png": "png bmp".split(),
    "jpg": "jpg jpeg".split(),
    "docx": "docx doc".split(),
    "xlsx": "xlsx xls".split(),
    "pptx": "pptx ppt".split(),
    "web": "html mhtml htm".split(),
    "config": "json yaml yml toml ini properties".split(),
    "code": "java js ts py sh bash sql dtd xsd xml css mjs c cpp h hpp cs go rs rb php pl pm tcl r swift kt groovy scala dart lua tsv".split(),
    "text": "csv txt md".split(),
    "archive": "log zip tar gz bz2 xz 7z rar tar.gz tar.bz2 tar.xz tar.7z tar.rar jar war ear apk ipa deb rpm msi dmg iso".split(),
}
#: The setting filetype.<type>.enabled that turns a format on.
FILE_TYPE = {
    "pdf": "pdf", "png": "image", "jpg": "image", "docx": "text", "xlsx": "spreadsheet", "pptx": "presentation",
    "web": "web", "config": "config", "code": "code", "text": "text", "archive": "archive", "other": "other",
}
#: Types read unless a setting says otherwise; a type without a default is off.
ENABLED = {"text": True, "spreadsheet": True, "web": True, "code": True, "config": True, "archive": False, "presentation": True, "pdf": True, "image": True, "other": False}
IGNORED_BY_DEFAULT = [
    "**/node_modules/**", "**/.git/**", "**/.idea/**", "**/.vscode/**", "**/target/**", "**/build/**", "**/*.class", "**/*.log",
    "**/.DS_Store", "**/Thumbs.db", "**/*.swp", "**/__pycache__/**", "**/*.pyc",
]
