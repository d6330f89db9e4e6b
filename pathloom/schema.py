"""Tables and fixed values of the index."""

from __future__ import annotations

from pyspark.sql import types as T

ROOT = 1
#: A path stops after this many directories above an entry, with a placeholder.
MAX_DEPTH = 4097

# Fixed values of the on-disk format.
NO_SNAP = (1 << 64) - 2
S_IFMT, S_IFDIR, S_IFREG, S_IFLNK = 0o170000, 0o040000, 0o100000, 0o120000
ON_DISK_MAGIC = "ceph fs volume v011"
MAX_FRAG_TREE = 1 << 20

FILE, DIR, SYMLINK, HARDLINK, OTHER = "f", "d", "l", "h", "o"
SELECTABLE = {"file": FILE, "dir": DIR, "symlink": SYMLINK, "hardlink": HARDLINK}

ENTRIES = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField(
        "parent",
        T.LongType(),
    ), T.StructField("name", T.StringType()), T.StructField("ino", T.LongType()),
    T.StructField(
        "type",
        T.StringType(),
    ), T.StructField("uid", T.LongType()), T.StructField("gid", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("mtime", T.LongType()), T.StructField("ctime", T.LongType()), T.StructField("rctime", T.LongType()),
])
META = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
