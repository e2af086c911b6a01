"""Row types of the event log and the tables around it."""

from pyspark.sql import types as T

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


EVENT = _struct(
    message_id=_S, schedule_ts=_L, payload=T.BinaryType(), topic=_S, meta=T.MapType(_S, _S), created_ts=_L,
    offset=_L, partition_id=_I, checksum=_L, term=_L,
)
GROUP_OFFSET = _struct(group_id=_S, partition_id=_I, committed=_L)
GROUP_MEMBER = _struct(group_id=_S, member_id=_S, address=_S)
DELIVERY = _struct(delivery_id=_S, subscription_id=_S, offset=_L, attempt=_I, deadline=_L)
DLQ_ENTRY = _struct(delivery_id=_S, last_error=_S, subscriber=_S, attempts=_I, failed_at=_L, partition_id=_I, tombstone=_B)
SEGMENT = _struct(partition_id=_I, segment_id=_L, first_offset=_L, last_offset=_L, created_ts=_L, size=_L)
CHANGE = _struct(timestamp=_L, op=_S, partition_id=_I, topic=_S, offset=_L, event=EVENT)
SCHEMA_VERSION = _struct(topic=_S, version=_I, type=_S, definition=_S, hash=_L)
AUDIT = _struct(timestamp=_S, action=_S, subject=_S, resource=_S, outcome=_S, detail=_S, source_ip=_S, request_id=_S)
TX_RECORD = _struct(tx_id=_S, status=_S, partition_ids=T.ArrayType(_I), created_at=_L, committed_at=_L)
ASSIGNMENT = _struct(partition_id=_I, leader_id=_S, replicas=T.ArrayType(_S), isr=T.ArrayType(_S), epoch=_L, replica_offsets=T.MapType(_S, _L))
SNAPSHOT = _struct(version=_I, partition_id=_I, high_watermark=_L, last_scheduled=_L, group_offsets=T.MapType(_S, _L))
