"""The fixed schemas. A snapshot is a DataFrame of entries with a unique path."""

ENTRIES = "path string, kind string, len bigint, mtime_s bigint, mtime_ns int, mode int, uid int, gid int, dev bigint, ino bigint, target string, hash string"
INDEX = f"{ENTRIES}, version int"
JOURNAL = "seq bigint, op string, path string, record string, checksum string"
RUN_EVENTS = "run_id string, seq bigint, ts timestamp, event string, phase string, path string, action string, bytes bigint, detail string"
BENCH_RUNS = "cache string, scenario string, tool string, seconds double, files bigint, bytes bigint, files_per_sec double, gib_per_sec double, filesystem string"
#: Version of stored indexes; others count as missing.
INDEX_VERSION = 3
ENTRY_COLUMNS = [c.split()[0] for c in ENTRIES.split(", ")]
