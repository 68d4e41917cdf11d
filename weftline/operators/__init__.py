"""Relational operators: functions of frames, and classes that hold their arguments."""

from .relational import (
    Batch,
    DropPacketColumns,
    DropTagColumns,
    Filter,
    Join,
    MapPackets,
    MapTags,
    Operator,
    SelectPacketColumns,
    SelectTagColumns,
    SemiJoin,
)

__all__ = ["Batch", "DropPacketColumns", "DropTagColumns", "Filter", "Join", "MapPackets", "MapTags", "Operator", "SelectPacketColumns", "SelectTagColumns", "SemiJoin"]
