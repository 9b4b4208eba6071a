"""Streaming entry points.

The analyses are batch over a whole extract: there is no stream, watermark,
window-over-time or state in what they compute.  What carries over is the
source contract: the same reader by header, the same stateless line repair
and the same split of refused rows apply to a file stream, so new extract
files can be judged and repaired as they land and appended to a table the
batch marts read.
"""

from tillpoint.streaming.lines import judged_line_stream, repaired_line_stream, write_repaired_lines

__all__ = ["judged_line_stream", "repaired_line_stream", "write_repaired_lines"]
