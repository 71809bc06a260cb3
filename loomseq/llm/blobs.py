"""The functions of this name, under the name the operators of this subpackage know."""

from ..functions.blobs import by_bucket, dump, load, pack_bits, rows, unpack_bits

__all__ = ["by_bucket", "dump", "load", "pack_bits", "rows", "unpack_bits"]
