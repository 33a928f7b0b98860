"""What several tests build."""

import struct


def item(kind, body, flags=0):
    """An object of a journal."""
    data = bytes([kind, flags]) + bytes(6) + struct.pack("<Q", 16 + len(body)) + body
    return data + bytes(-len(data) % 8)
