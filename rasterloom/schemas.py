"""Engine schemas and the fixed values of the data model."""

from __future__ import annotations

FRAME = "width BIGINT, height BIGINT, bit_depth INT, primaries INT, transfer INT, matrix INT, flags INT, tile_size_log2 INT, max_cll INT, max_fall INT"
CHUNKS = "image_id STRING, seq INT, type STRING, flags INT, size BIGINT, payload BINARY"
TILES = "image_id STRING, tile_x INT, tile_y INT, layer_flags INT, payload BINARY"
FRAMES = f"image_id STRING, {FRAME}, frame_count INT, n_tiles INT"
PIXELS = "image_id BIGINT, y INT, x INT, r INT, g INT, b INT"
IMAGES = "image_id STRING, width INT, height INT, bit_depth INT, has_alpha BOOLEAN, pixels BINARY"
META = "image_id STRING, ord INT, ns INT, tag INT, type_id INT, value STRING, opaque BINARY"

# The zigzag order of an 8x8 block, row-major places by rank.
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5,
    12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51,
    58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]

# Colour matrices by code point (rows R, G, B weights of Y, Cb, Cr) and their inverses
# (R from Cr, G from Cb, G from Cr, B from Cb).
YCBCR = {
    1: ((0.2126, 0.7152, 0.0722), (-0.1146, -0.3854, 0.5), (0.5, -0.4542, -0.0458)),
    5: ((0.299, 0.587, 0.114), (-0.1687, -0.3313, 0.5), (0.5, -0.4187, -0.0813)),
    9: ((0.2627, 0.678, 0.0593), (-0.1396, -0.3604, 0.5), (0.5, -0.4598, -0.0402)),
}
YCBCR[6] = YCBCR[5]
RGB = {1: (1.5748, -0.1873, -0.4681, 1.8556), 5: (1.402, -0.3441, -0.7141, 1.772), 9: (1.4746, -0.1646, -0.5714, 1.8814)}
RGB[6] = RGB[5]

# Header flags, chunk flags and tile layers.
FLAGS = {"lossless": 1, "animated": 2, "alpha": 4, "hdr": 8, "tiled": 16, "has_meta": 32, "has_c2pa": 64, "full_range": 128}
CHUNK_FLAGS = {"optional": 1, "meta_only": 2, "repeatable": 4}
LAYERS = {"base": 1, "refinement": 2, "alpha": 4}

# Metadata namespaces by number, and type numbers.
NAMESPACES = {1: "capture", 2: "geo", 3: "time", 4: "rights", 5: "content", 6: "anim", 7: "region", 8: "device", 9: "rating", 10: "custom", 11: "provRef"}
TYPES = {1: "uint8", 2: "uint16", 3: "uint32", 4: "uint64", 5: "int32", 6: "float32", 7: "float64", 8: "rational", 9: "lstr", 10: "str", 11: "bytes", 12: "array", 13: "struct", 14: "ts64", 15: "uuid"}

# The container's first bytes, its version, and its files' ending.
MAGIC, VERSION, SUFFIX = b"WKIMG", 1, "wk"
