"""Registries as plain data: signatures, extensions, text types, rules. New formats and rules are added here."""

from __future__ import annotations

from typing import NamedTuple


class Signature(NamedTuple):
    type: str
    label: str
    mime: str
    category: str
    extension: str
    offset: int
    pattern: str  # hex; "??" is a wildcard
    weight: int = 1


# The signature registry, in its order. Higher weights come first, equal ones in this order.
SIGNATURES = [
    Signature("pdf", "Portable Document Format", "application/pdf", "document", "pdf", 0, "255044462D", 10),
    Signature("rtf", "Rich Text Format", "application/rtf", "document", "rtf", 0, "7B5C727466"),
    Signature("ole", "Legacy Microsoft Office / OLE2 Compound File", "application/x-ole-storage", "document", "doc", 0, "D0CF11E0A1B11AE1"),
    Signature("zip", "ZIP Archive", "application/zip", "archive", "zip", 0, "504B0304"),
    Signature("zip", "ZIP Archive (empty)", "application/zip", "archive", "zip", 0, "504B0506"),
    Signature("zip", "ZIP Archive (spanned)", "application/zip", "archive", "zip", 0, "504B0708"),
    Signature("rar", "RAR Archive", "application/vnd.rar", "archive", "rar", 0, "52617221"),
    Signature("7z", "7-Zip Archive", "application/x-7z-compressed", "archive", "7z", 0, "377ABCAF271C"),
    Signature("gz", "GZIP Compressed Data", "application/gzip", "archive", "gz", 0, "1F8B"),
    Signature("bz2", "BZIP2 Compressed Data", "application/x-bzip2", "archive", "bz2", 0, "425A68"),
    Signature("xz", "XZ Compressed Data", "application/x-xz", "archive", "xz", 0, "FD377A585A00"),
    Signature("tar", "TAR Archive", "application/x-tar", "archive", "tar", 257, "7573746172"),
    Signature("zstd", "Zstandard Compressed Data", "application/zstd", "archive", "zst", 0, "28B52FFD"),
    Signature("jpeg", "JPEG Image", "image/jpeg", "image", "jpg", 0, "FFD8FF"),
    Signature("png", "PNG Image", "image/png", "image", "png", 0, "89504E470D0A1A0A", 10),
    Signature("gif", "GIF Image", "image/gif", "image", "gif", 0, "47494638"),
    Signature("bmp", "Bitmap Image", "image/bmp", "image", "bmp", 0, "424D"),
    Signature("tiff", "TIFF Image", "image/tiff", "image", "tiff", 0, "49492A00"),
    Signature("tiff", "TIFF Image (big endian)", "image/tiff", "image", "tiff", 0, "4D4D002A"),
    Signature("webp", "WebP Image", "image/webp", "image", "webp", 8, "57454250", 10),
    Signature("ico", "Windows Icon", "image/x-icon", "image", "ico", 0, "00000100"),
    Signature("heic", "HEIC Image", "image/heic", "image", "heic", 4, "6674797068656963", 10),
    Signature("psd", "Photoshop Document", "image/vnd.adobe.photoshop", "image", "psd", 0, "38425053"),
    Signature("mp3", "MP3 Audio", "audio/mpeg", "audio", "mp3", 0, "494433"),
    Signature("mp3", "MP3 Audio (frame sync)", "audio/mpeg", "audio", "mp3", 0, "FFFB"),
    Signature("wav", "WAV Audio", "audio/wav", "audio", "wav", 8, "57415645", 10),
    Signature("flac", "FLAC Audio", "audio/flac", "audio", "flac", 0, "664C6143"),
    Signature("ogg", "OGG Container", "audio/ogg", "audio", "ogg", 0, "4F676753"),
    Signature("m4a", "MPEG-4 Audio", "audio/mp4", "audio", "m4a", 4, "667479704D3441", 12),
    Signature("aac", "AAC Audio (ADTS)", "audio/aac", "audio", "aac", 0, "FFF1"),
    Signature("wma", "Windows Media (ASF)", "audio/x-ms-wma", "audio", "wma", 0, "3026B275"),
    Signature("mp4", "MPEG-4 Video", "video/mp4", "video", "mp4", 4, "66747970", 5),
    Signature("mkv", "Matroska / WebM Container", "video/x-matroska", "video", "mkv", 0, "1A45DFA3"),
    Signature("avi", "AVI Video", "video/x-msvideo", "video", "avi", 8, "41564920", 10),
    Signature("mov", "QuickTime Movie", "video/quicktime", "video", "mov", 4, "667479707174", 12),
    Signature("flv", "Flash Video", "video/x-flv", "video", "flv", 0, "464C56"),
    Signature("mpeg", "MPEG Program Stream", "video/mpeg", "video", "mpeg", 0, "000001BA"),
    Signature("pe", "Windows Executable (PE)", "application/vnd.microsoft.portable-executable", "binary", "exe", 0, "4D5A"),
    Signature("elf", "ELF Executable / Shared Object", "application/x-elf", "binary", "elf", 0, "7F454C46"),
    Signature("macho", "Mach-O Executable", "application/x-mach-binary", "binary", "macho", 0, "CFFAEDFE"),
    Signature("class", "Java Class File", "application/java-vm", "binary", "class", 0, "CAFEBABE"),
    Signature("wasm", "WebAssembly Module", "application/wasm", "binary", "wasm", 0, "0061736D"),
    Signature("sqlite", "SQLite Database", "application/vnd.sqlite3", "data", "sqlite", 0, "53514C69746520666F726D61742033"),
    Signature("parquet", "Apache Parquet", "application/vnd.apache.parquet", "data", "parquet", 0, "50415231"),
    Signature("avro", "Apache Avro", "application/avro", "data", "avro", 0, "4F626A01"),
    Signature("feather", "Arrow / Feather", "application/vnd.apache.arrow.file", "data", "feather", 0, "4152524F5731"),
    Signature("dex", "Android DEX", "application/x-dex", "binary", "dex", 0, "6465780A"),
]
WEAK_TYPES = ["bmp", "aac", "mp3"]

# Types that only content shows, as (type, label, mime, category, extension, confidence).
TEXT_TYPES = {
    "svg": ("svg", "Scalable Vector Graphics", "image/svg+xml", "image", "svg"),
    "html": ("html", "HTML Document", "text/html", "document", "html"),
    "xml": ("xml", "XML Document", "application/xml", "data", "xml"),
    "json": ("json", "JSON Document", "application/json", "data", "json"),
    "jsonl": ("jsonl", "JSON Lines", "application/x-ndjson", "data", "jsonl"),
    "sql": ("sql", "SQL Script", "application/sql", "data", "sql"),
    "script": ("script", "Source Code / Script", "text/plain", "text", "txt"),
    "yaml": ("yaml", "YAML Document", "application/yaml", "data", "yaml"),
    "markdown": ("markdown", "Markdown Document", "text/markdown", "document", "md"),
    "csv": ("csv", "Comma-Separated Values", "text/csv", "data", "csv"),
    "ssv": ("csv", "Semicolon-Separated Values", "text/csv", "data", "csv"),
    "tsv": ("tsv", "Tab-Separated Values", "text/tab-separated-values", "data", "tsv"),
    "txt": ("txt", "Plain Text", "text/plain", "text", "txt"),
}
# What a ZIP or OLE container turns out to be: type, label, mime, category, extension, confidence, evidence.
CONTAINER_TYPES = [
    ("odt", "OpenDocument Text", "application/vnd.oasis.opendocument.text", "document", "odt", 99, "OpenDocument mimetype entry"),
    ("ods", "OpenDocument Spreadsheet", "application/vnd.oasis.opendocument.spreadsheet", "data", "ods", 99, "OpenDocument mimetype entry"),
    ("odp", "OpenDocument Presentation", "application/vnd.oasis.opendocument.presentation", "document", "odp", 99, "OpenDocument mimetype entry"),
    ("epub", "EPUB eBook", "application/epub+zip", "document", "epub", 99, "EPUB mimetype entry"),
    ("docx", "Microsoft Word Document (OOXML)", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "document", "docx", 99, "OOXML part matching ^word\\/"),
    ("xlsx", "Microsoft Excel Workbook (OOXML)", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "data", "xlsx", 99, "OOXML part matching ^xl\\/"),
    ("pptx", "Microsoft PowerPoint Presentation (OOXML)", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "document", "pptx", 99, "OOXML part matching ^ppt\\/"),
    ("apk", "Android Application Package", "application/vnd.android.package-archive", "binary", "apk", 98, "AndroidManifest.xml + classes.dex"),
    ("jar", "Java Archive", "application/java-archive", "binary", "jar", 96, "META-INF manifest + compiled classes"),
    ("zip", "ZIP Archive", "application/zip", "archive", "zip", 97, None),
    ("xls", "Microsoft Excel 97-2003 Workbook", "application/vnd.ms-excel", "data", "xls", 92, "Workbook stream found"),
    ("ppt", "Microsoft PowerPoint 97-2003", "application/vnd.ms-powerpoint", "document", "ppt", 92, "PowerPoint Document stream"),
    ("doc", "Microsoft Word 97-2003 Document", "application/msword", "document", "doc", 92, "WordDocument stream"),
    ("ole", "Legacy Microsoft Office / OLE2 Compound File", "application/x-ole-storage", "document", "doc", 80, "Specific stream not identified"),
]
# The type that each extension stands for.
EXTENSION_MAP = {
    "pdf": "pdf", "rtf": "rtf", "doc": "ole", "xls": "ole", "ppt": "ole", "msg": "ole", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "odt": "odt",
    "ods": "ods", "odp": "odp", "epub": "epub", "jar": "jar", "apk": "apk", "zip": "zip", "rar": "rar", "7z": "7z", "gz": "gz", "tgz": "gz",
    "bz2": "bz2", "xz": "xz", "tar": "tar", "zst": "zstd", "jpg": "jpeg", "jpeg": "jpeg", "png": "png", "gif": "gif", "bmp": "bmp", "tif": "tiff",
    "tiff": "tiff", "webp": "webp", "ico": "ico", "heic": "heic", "svg": "svg", "psd": "psd", "mp3": "mp3", "wav": "wav", "flac": "flac",
    "ogg": "ogg", "m4a": "m4a", "aac": "aac", "wma": "wma", "mp4": "mp4", "mkv": "mkv", "webm": "mkv", "avi": "avi", "mov": "mov", "flv": "flv",
    "mpeg": "mpeg", "mpg": "mpeg", "exe": "pe", "dll": "pe", "sys": "pe", "elf": "elf", "so": "elf", "class": "class", "wasm": "wasm", "dex": "dex",
    "sqlite": "sqlite", "db": "sqlite", "parquet": "parquet", "avro": "avro", "feather": "feather", "txt": "txt", "md": "markdown", "csv": "csv",
    "tsv": "tsv", "json": "json", "jsonl": "jsonl", "xml": "xml", "yaml": "yaml", "yml": "yaml", "sql": "sql", "html": "html", "htm": "html",
    "js": "script", "ts": "script", "py": "script", "sh": "script", "ps1": "script", "bat": "script", "cmd": "script", "vbs": "script",
}
# All extensions that a type accepts, where they are more or fewer than its own one.
ALIASES = {
    "jpeg": "jpg jpeg", "tiff": "tif tiff", "mpeg": "mpg mpeg", "yaml": "yml yaml", "markdown": "md markdown", "mkv": "mkv webm", "pe": "exe dll sys scr com", "elf": "elf so bin out", "txt": "txt log text conf ini cfg",
    "script": "js ts py sh ps1 bat cmd vbs rb go java c cpp", "sqlite": "sqlite sqlite3 db", "gz": "gz tgz", "zip": "zip", "ole": "doc xls ppt msg", "doc": "doc", "xls": "xls", "ppt": "ppt",
}
# Extensions of what a system may run, types that run, types that are dense by nature.
EXECUTABLE = "exe dll scr com pif bat cmd msi vbs vbe js jse wsf wsh ps1 psm1 jar apk app sh run elf so dylib hta cpl".split()
RUNNABLE_TYPES = "pe elf macho apk jar class dex wasm".split()
COMPRESSED_TYPES = "zip 7z rar gz bz2 xz zstd jpeg png webp mp3 mp4 mkv docx xlsx pptx heic flac".split()
ZIP_TYPES = "docx xlsx pptx odt ods odp zip epub jar apk".split()
SCRIPT_TYPES = "txt script html svg xml json yaml sql markdown csv".split()
RISK_LEVELS = [(80, "CRITICAL"), (60, "HIGH"), (35, "MEDIUM"), (12, "LOW"), (0, "SAFE")]
RISK_ORDER = ["SAFE", "LOW", "MEDIUM", "HIGH", "CRITICAL", "UNKNOWN"]
RISK_LABELS = {"SAFE": "No indicators", "LOW": "Low risk", "MEDIUM": "Medium risk", "HIGH": "High risk", "CRITICAL": "Critical", "UNKNOWN": "Scan incomplete"}
ALERT_LEVELS = ["MEDIUM", "HIGH", "CRITICAL", "UNKNOWN"]


class Rule(NamedTuple):
    id: str
    pattern: str  # understood alike by Java and RE2
    category: str
    severity: str
    points: int
    description: str
    recommendation: str
    evidence: str | None = None  # a fixed text; None: what matched
    piped: tuple[str, str] | None = None  # the pattern's parts before and after a |, for a search in linear time


_NAME_ADVICE = "Treat this file as untrusted; verify the sender through another channel."
_SCRIPT_ADVICE = "Review the script statically before running it anywhere."
# Rules on names, on PDF text and on script text, in the order in which findings are reported.
NAME_RULES = [
    Rule("R1", r"(?i)\.(pdf|doc|docx|xls|xlsx|jpg|jpeg|png|txt)\.(exe|scr|com|bat|cmd|js|vbs|ps1|jar|msi|hta)\z", "Filename", "high", 25, "Double extension disguising an executable", _NAME_ADVICE),
    Rule("R2", r"(?i)(invoice|receipt|payment|statement|resume|cv|urgent|payroll|refund)[-_ ]?\d*\.(exe|scr|js|vbs|jar|hta|msi)\z", "Filename", "high", 25, "Social-engineering filename on an executable", _NAME_ADVICE),
    Rule("R3", "\u202e", "Filename", "high", 25, "Right-to-left override character in filename (extension spoofing)", _NAME_ADVICE),
    Rule("R4", r"(?i)(crack|keygen|patch|activator|loader)", "Filename", "high", 25, "Filename associated with cracked software bundles", _NAME_ADVICE),
]
PDF_RULES = [
    Rule("P1", r"/JavaScript|/JS[\s/<]", "PDF active content", "high", 28, "PDF contains JavaScript", "Do not open with a viewer that allows scripting.", r"\/JavaScript|\/JS[\s/<]"),
    Rule("P2", r"/OpenAction", "PDF active content", "high", 22, "PDF defines an automatic action on open", "Inspect the action target before opening.", r"\/OpenAction"),
    Rule("P3", r"/AA[\s/<]", "PDF active content", "medium", 14, "PDF defines additional automatic actions", "Treat auto-triggered behaviour as untrusted.", r"\/AA[\s/<]"),
    Rule("P4", r"/Launch", "PDF active content", "critical", 34, "PDF contains a Launch action (can start external programs)", "Do not open. Launch actions are commonly abused.", r"\/Launch"),
    Rule("P5", r"/EmbeddedFile", "PDF active content", "medium", 16, "PDF embeds one or more files", "Extract embedded files only in an isolated environment.", r"\/EmbeddedFile"),
    Rule("P6", r"/RichMedia|/Flash", "PDF active content", "medium", 12, "PDF embeds rich media / Flash content", "Disable multimedia in your PDF reader.", r"\/RichMedia|\/Flash"),
    Rule("P7", r"/URI\s*\(", "PDF active content", "low", 4, "PDF contains external URI links", "Verify link targets before clicking.", r"\/URI\s*\("),
    Rule("P8", r"/AcroForm", "PDF active content", "info", 0, "PDF contains interactive form fields", "Informational only.", r"\/AcroForm"),
    Rule("P9", r"/Encrypt[\s/<]", "Encryption", "low", 6, "PDF is encrypted or password protected", "Content extraction may be limited.", "/Encrypt dictionary present"),
]
SCRIPT_RULES = [
    Rule("C1", r"eval\s*\(|new\s+Function\s*\(", "Script analysis", "high", 20, "Dynamic code evaluation (eval / Function constructor)", _SCRIPT_ADVICE),
    Rule("C2", r"(?i)FromBase64String|atob\s*\(|base64\s+-d", "Script analysis", "medium", 12, "Base64 decoding of embedded payload", _SCRIPT_ADVICE),
    Rule("C3", r"(?i)Invoke-Expression|IEX\s|powershell\s+-e(nc)?\b", "Script analysis", "critical", 30, "Encoded PowerShell execution", _SCRIPT_ADVICE),
    Rule("C4", r"(?i)WScript\.Shell|Shell\.Application|cmd\.exe\s*/c", "Script analysis", "high", 22, "Shell command execution primitives", _SCRIPT_ADVICE),
    Rule("C5", r"(?i)curl\s+[^|]*\|\s*(ba)?sh|wget\s+[^|]*\|\s*(ba)?sh", "Script analysis", "critical", 30, "Download-and-execute pipeline", _SCRIPT_ADVICE, None, (r"(?i)(curl|wget)\s[\s\S]*", r"(?i)\A\s*(ba)?sh")),
    Rule("C6", r"urllib|requests\.get|XMLHttpRequest|fetch\s*\(", "Script analysis", "low", 6, "Outbound network request in script", _SCRIPT_ADVICE),
    Rule("C7", r"document\.write|innerHTML\s*=", "Script analysis", "low", 5, "DOM injection primitives", _SCRIPT_ADVICE),
    Rule("C8", r"(?i)<script[\s>]", "Script analysis", "medium", 12, "Embedded script tag", _SCRIPT_ADVICE),
    Rule("C9", r"(?i)on(load|error|click)\s*=\s*[\x22\x27]", "Script analysis", "medium", 10, "Inline event handler attribute", _SCRIPT_ADVICE),
]


class Noted(NamedTuple):
    category: str
    severity: str
    points: int
    description: str  # {} stands for a value
    recommendation: str


# What the findings say whose conditions are more than a pattern.
FINDINGS = {
    "R5a": Noted("Extension mismatch", "critical", 45, 'The filename claims ".{}" but the content is {}', "Executable content hidden behind a harmless extension is a strong malware indicator. Do not open."),
    "R5b": Noted("Extension mismatch", "medium", 18, 'The filename claims ".{}" but the content is {}', "Rename to .{} and open with the matching application."),
    "R6": Noted("Extension", "low", 5, "File has no extension; type was established from content only", "Add the extension .{} if the detection looks correct."),
    "R7a": Noted("Executable content", "high", 40, "{} contains machine-executable or bytecode content", "Only run software from sources you trust. This platform never executes uploads."),
    "R7b": Noted("Executable content", "medium", 20, "{} contains machine-executable or bytecode content", "Only run software from sources you trust. This platform never executes uploads."),
    "R8": Noted("Entropy", "medium", 14, "Very high entropy for this file type — data may be packed, encrypted or obfuscated", "High entropy alone is not proof of malice, but combined with executable content it is a packing indicator."),
    "R9": Noted("Unrecognised format", "medium", 15, "The file format could not be identified from its content", "Unknown does not mean safe. Handle in an isolated environment."),
    "Z1": Noted("Office macros", "high", 35, "Document contains a VBA macro project", "Do not enable macros unless you fully trust the origin."),
    "Z2": Noted("Embedded executable", "critical", 40, "Container includes executable or script files", "Do not extract and run the contained files."),
    "Z3": Noted("Nested archive", "medium", 15, "Archive contains further archives (nesting is used to evade scanners)", "Inspect nested archives separately with recursion limits."),
    "Z4": Noted("Password protected", "medium", 20, "Archive entries are encrypted; contents cannot be inspected", "Encrypted archives are a common way to bypass scanning. Verify the sender."),
    "Z5": Noted("Path traversal", "critical", 45, "Archive entry names attempt to escape the extraction directory", "Do not extract with a tool that honours absolute or relative paths."),
    "Z6": Noted("Decompression bomb", "critical", 45, "Extreme compression ratio — likely a decompression bomb", "Do not extract this archive."),
    "Z7": Noted("Archive structure", "low", 6, "Archive holds a very large number of entries ({})", "Large archives can exhaust resources during extraction."),
    "Z8": Noted("Remote content", "high", 30, "Document references a remote template or embedded object over the network", "Remote template injection is a known malware delivery technique."),
    "Z9": Noted("Archive limits", "medium", 20, "Members of the archive were left out at the limits of its analysis", "Unpack it in an isolated environment if its contents matter."),
    "C10": Noted("CSV injection", "medium", 14, "Cells begin with formula characters (=, +, -, @) — spreadsheet formula injection risk", "Open with formula evaluation disabled."),
    "C11": Noted("Suspicious URL", "medium", 12, "{} suspicious URL(s) found (raw IP, shortener or high-abuse TLD)", "Do not visit these links."),
    "X1": Noted("Static imports", "high", 25, "Executable references APIs commonly used for injection, persistence or download-and-run", "Analyse in a dedicated malware sandbox, never on a workstation."),
    "Y1": Noted("Polyglot file", "high", 30, "Image file also contains a complete ZIP archive structure (polyglot)", "Polyglot files are used to smuggle payloads past filters."),
    "E1": Noted("Scan error", "medium", 10, "Part of the security scan could not complete", "Do not treat this file as safe — the scan is incomplete."),
    "none": Noted("Baseline", "info", 0, "No security rule triggered during static analysis", "Static analysis cannot prove a file is safe, only that no known indicator was found."),
}
URL_PATTERN = r"https?://[^\s\x22\x27<>)]+"
BAD_URL_PATTERN = r"(?i)\d{1,3}(\.\d{1,3}){3}|\.(ru|tk|xyz|top|gq|cf)\b|bit\.ly|tinyurl"
API_NAMES = "VirtualAlloc WriteProcessMemory CreateRemoteThread SetWindowsHookEx URLDownloadToFile WinExec ShellExecute RegSetValue CryptEncrypt IsDebuggerPresent".split()
# Limits.
MAX_FILE, SAMPLE_BYTES, TEXT_SAMPLE, PROBE_BYTES, OLE_BYTES = 52_428_800, 1_000_000, 8_192, 262_144, 65_536
PDF_BYTES, SCRIPT_BYTES, API_BYTES, EXTRACT_BYTES, MAX_TEXT = 5_000_000, 2_000_000, 3_000_000, 5_000_000, 60_000


def ranked_signatures() -> list[Signature]:
    """All signatures in the order in which the first that matches is the file's."""
    return sorted(SIGNATURES, key=lambda s: -s.weight)


def confidence_of(s: Signature) -> float:
    """How sure a match makes: longer patterns more; some short ones are weak whatever they say."""
    return 82.0 if s.type in WEAK_TYPES else float(min(99.9, 90 + min(9, len(s.pattern) // 2)))
