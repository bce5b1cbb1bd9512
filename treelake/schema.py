"""Tables, error codes and operation codes of the namespace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers are places in the lists.
ERROR_CODES = [
    "SUCCESS", "PATH_IS_INVALID", "PATH_IS_ROOT", "PATH_EXISTS", "PATH_NOT_EXISTS", "PATH_LOCK_CONFLICT",
    "PATH_VERIFY_FAILED", "REMOTE_TRANSFER_FAILED", "WRONG_WORKER", "OBSOLETE_SHARD", "REMOTE_QUERY_FAILED",
    "ARGUMENT_ERROR", "INODE_ROW_TYPE_ERROR", "FILE_EXISTS", "FILE_NOT_EXISTS", "OUT_OF_MEMORY", "STREAM_ERROR",
    "PROGRAM_ERROR", "SMART_ROUTE_ERROR", "UNDEFINED", "MKDIR_DUPLICATE", "XKEY_EXISTS", "XKEY_NOT_EXISTS",
    "VERSION_OUT_OF_DATE", "INVALID_PARAMETER", "UNKNOWN", "SERVER_FAULT", "ZK_NOT_CONNECT", "ZK_FETCH_RESULT_FAILED",
    "TRANSACTION_FAULT", "POOLED_FAULT", "NOT_FOUND_FD", "GET_ALL_WORKER_CONN_FAILED", "IO_ERROR", "READDIR_RENEW_CONN",
]
OPCODES = [
    "PLAIN_COMMAND", "MKDIR", "MKDIR_SUB_MKDIR", "MKDIR_SUB_CREATE", "CREATE", "STAT", "OPEN", "CLOSE", "UNLINK",
    "READDIR", "OPENDIR", "RMDIR", "RMDIR_SUB_RMDIR", "RMDIR_SUB_UNLINK", "RENAME", "RENAME_SUB_RENAME_LOCALLY",
    "RENAME_SUB_CREATE", "UTIMENS", "CHOWN", "CHMOD", "KV_PUT", "KV_GET", "KV_DEL", "SLICE_PUT", "SLICE_GET",
    "SLICE_DEL", "FETCH_SLICE_ID",
]
BATCHED = ["MKDIR", "CREATE", "STAT", "UNLINK", "OPEN", "CLOSE", "KV_PUT", "KV_GET", "KV_DEL", "SLICE_PUT", "SLICE_GET", "SLICE_DEL"]
#: Operations in the numbering of the other transport, from 1.
TRANSPORT_OPCODES = [
    "KV_PUT", "KV_GET", "KV_DEL", "PLAIN_COMMAND", "MKDIR", "CREATE", "STAT", "OPEN", "CLOSE", "UNLINK", "READDIR",
    "OPENDIR", "RMDIR", "RENAME", "MKDIR_SUB_MKDIR", "MKDIR_SUB_CREATE", "RMDIR_SUB_RMDIR", "RMDIR_SUB_UNLINK",
    "RENAME_SUB_RENAME_LOCALLY", "RENAME_SUB_CREATE", "UTIMENS", "CHOWN", "CHMOD", "SLICE_PUT", "SLICE_GET",
    "SLICE_DEL", "FETCH_SLICE_ID",
]
#: errno of the codes that have one of their own; the others are 5 (EIO).
ERRNO = {
    "SUCCESS": 0, "PATH_IS_INVALID": 2, "PATH_NOT_EXISTS": 2, "FILE_NOT_EXISTS": 2, "XKEY_NOT_EXISTS": 2,
    "WRONG_WORKER": 3, "OBSOLETE_SHARD": 6, "NOT_FOUND_FD": 9, "UNDEFINED": 11, "POOLED_FAULT": 11,
    "OUT_OF_MEMORY": 12, "PROGRAM_ERROR": 14, "FILE_EXISTS": 17, "XKEY_EXISTS": 17, "MKDIR_DUPLICATE": 20,
    "ARGUMENT_ERROR": 22, "PATH_VERIFY_FAILED": 22, "INODE_ROW_TYPE_ERROR": 84, "SERVER_FAULT": 104,
    "ZK_NOT_CONNECT": 107, "SMART_ROUTE_ERROR": 113, "GET_ALL_WORKER_CONN_FAILED": 113, "REMOTE_QUERY_FAILED": 121,
}

FILE_MODE, DIR_MODE = 0o100644, 0o040755
TYPE_MASK, FILE_TYPE, DIR_TYPE = 0o170000, 0o100000, 0o040000
ROOT_ID = 1 << 12
PART_BITS, NODE_BITS = 13, 12
INODE_COLUMNS = [
    "name", "st_ino", "parentid_partid", "st_dev", "st_mode", "st_nlink", "st_uid", "st_gid", "st_rdev", "st_size",
    "st_blksize", "st_blocks", "st_atim", "st_mtim", "st_ctim", "etag", "update_version", "primary_nodeid", "backup_nodeid",
]
XATTR_SCHEMA = "parentid_partid long, name string, xKey string, xValue string"
SLICE_SCHEMA = "inodeid long, chunkid int, sliceid long, slicesize int, sliceoffset int, slicelen int, sliceloc1 int, sliceloc2 int"
KV_SCHEMA = "user_key string, value_len int, slice_num short, value_key array<long>, location array<long>, slice_len array<int>"
DIRECTORY_SCHEMA = "parent_id long, name string, inodeid long"


def code(name: str) -> int:
    return ERROR_CODES.index(name)


def op(name: str) -> int:
    return OPCODES.index(name)


def lit_code(name: str) -> Column:
    return F.lit(code(name))


def error_name(column: Column) -> Column:
    return F.get(F.array(*map(F.lit, ERROR_CODES)), column)


def errno(column: Column) -> Column:
    """POSIX errno of an error code; EIO where it has none of its own."""
    return F.coalesce(F.get(F.array(*[F.lit(ERRNO.get(n, 5)) for n in ERROR_CODES]), column), F.lit(5))
