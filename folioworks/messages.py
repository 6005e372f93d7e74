"""Texts, statuses and codes that users of the data rely on word for word."""

# Statuses of an upload file, of a candidate and of a batch.
FILE_STATUSES = ("staged", "uploading", "uploaded", "processing", "processed", "partial", "rejected", "error")
TERMINAL = ("processed", "partial", "rejected", "error")
CANDIDATE_STATUSES = ("processed", "rejected")
BATCH_STATUSES = ("in_progress", "staged", "committed", "abandoned")
LIBRARY_STATUSES = ("active", "archived")
RISKS = ("HIGH", "MEDIUM", "LOW", "CONFIRMATORY")
DUPLICATE_KINDS = ("replace_requested", "same_title", "same_content")
RESOLUTIONS = ("pending", "create_new", "replace_existing", "discard")
INTENTS = ("new", "replace")

# Commit skips.
ALREADY_IN_LIBRARY = "Already in the library"
SAME_FILE_IN_BATCH = "Same file as another in this batch"
TITLE_IN_LIBRARY = "A document with this title is already in the library"
# Our own: a candidate that can be matched by neither content nor title.
INCOMPLETE_CANDIDATE = "Candidate has no content hash or no title"

# Our own: a write under a claim that is not, or no longer, the file's.
CLAIM_SUPERSEDED = "claim superseded"

# Lifecycle endings.
CANCELLED = "Upload cancelled"
ABANDONED = "Upload was not completed"
ATTEMPTS_SPENT = "Processing did not complete after the maximum number of attempts"
OBJECT_MISSING = "Uploaded object not found"

# Archive and entry verdicts.
TOO_LARGE_UNPACKED = "Archive is too large once unpacked"
DAMAGED = "Archive is damaged"
TOO_DEEP = "Folders nested too deeply — at most one subfolder is supported"
NO_EXTENSION = "Files without an extension are not supported"
FILE_DAMAGED = "File is damaged and cannot be read"
ARCHIVE_REJECTED = "Archive rejected"
BAD_CRC = "Bad CRC-32"

# What breaks the guard; the first six follow an entry's name in single quotes.
TOO_DENSE = " has an implausible compression ratio"
UNSAFE_PATH = " has an unsafe path"
ENCRYPTED = " is encrypted"
REPEATED = " appears more than once"
NAME_TOO_LONG = " has a file name longer than {} bytes"
PATH_TOO_LONG = " has a path longer than {} characters"
INDEX_DISAGREES = " does not match its index ("
TOO_MANY_FILES = " files; limit is {}"

# What is wrong with a file or an entry.
UNSAFE_FILE = "File is unsafe: "
WRONG_TYPE, WRONG_TYPE_FOUND = "File content does not match .", " — it appears to be "
NOT_SUPPORTED = " is not supported"
DUPLICATE, ALREADY_UPLOADED, ALREADY_QUEUED = "Duplicate file — ", " has already been uploaded.", " is already in the upload queue."
EMPTY_HTML, EMPTY_DOCUMENT = "The HTML file is empty.", "The document appears to be empty."

# The browser's checks of a selection and of what is inside an archive.
EMPTY_FILE = "File is empty."
BAD_PDF = "The PDF file is corrupted or invalid."
BAD_ZIP = "The ZIP file is corrupted or cannot be read."
ZIP_HAS_NOTHING = "The ZIP file does not contain any {} files that can be added."
NO_EXTENSION_INSIDE = "Files without an extension are not supported."
NOT_SUPPORTED_INSIDE = " is not supported inside a ZIP."
NOT_A_FORMAT = " is not a supported format"
FORMATS = "Unsupported file type. Supported formats: {}."
OVER_MAXIMUM = "File exceeds the maximum size of "

# Refusals of an upload request.
OVER_CLOUD_LIMIT = "File exceeds the {} MB limit for cloud uploads."
UNSUPPORTED = "Unsupported file type: "
BATCH, BATCH_CLOSED = "Batch ", " is already "
UPLOAD_NOT_FOUND = "404 Upload not found."
EXTENSION_NOT_ALLOWED = "': extension not allowed (allowed: {})"
KEY_OUTSIDE = "': s3_key must be under incoming/"

# Failure codes of the object store, by meaning.
NOT_FOUND_CODES = ("NoSuchKey", "404", "NotFound")
DENIED_CODES = ("AccessDenied", "403", "Forbidden", "InvalidAccessKeyId", "SignatureDoesNotMatch",
                "AllAccessDisabled", "AccountProblem", "InvalidToken", "ExpiredToken")
THROTTLED_CODES = ("SlowDown", "Throttling", "ThrottlingException", "RequestLimitExceeded", "TooManyRequests",
                   "RequestTimeout", "RequestTimeTooSkewed", "ServiceUnavailable", "InternalError")

# Magic numbers and the parts that make a zip a word-processing document.
ZIP_MAGIC = b"PK\x03\x04"
PDF_MAGIC = b"%PDF-"
CONTENT_TYPES_PART = "[Content_Types].xml"
DOCUMENT_PART = "word/document.xml"
WORDML_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"

# Namespace of the name-based (version 5) document ids.
DOCUMENT_NAMESPACE = "5b0e6c1e-6f1d-5c8a-9d0e-2a4c1b7e9f30"
