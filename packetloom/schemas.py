"""Field tables exported by a packet dissector, one schema per protocol."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _S = T.LongType(), T.StringType()


def _schema(fields: str, longs: str) -> T.StructType:
    numeric = set(longs.split())
    return T.StructType([T.StructField(name, _L if name in numeric else _S) for name in fields.split()])


PROTOCOLS: dict[str, T.StructType] = {
    "inventory": _schema(
        "frame_number time_epoch frame_length captured_length protocols ip_src ipv6_src ip_dst ipv6_dst "
        "tcp_stream tcp_srcport tcp_dstport tcp_len tcp_syn tcp_ack udp_stream udp_srcport udp_dstport udp_length",
        "frame_number frame_length captured_length tcp_stream tcp_srcport tcp_dstport tcp_len "
        "udp_stream udp_srcport udp_dstport udp_length",
    ),
    "http": _schema(
        "frame_number time_epoch frame_length captured_length stream_index ip_src ipv6_src ip_dst ipv6_dst "
        "source_port destination_port method uri full_uri host response_code response_phrase response_in_frame "
        "request_in_frame content_length content_type",
        "frame_number frame_length captured_length stream_index source_port destination_port response_code "
        "response_in_frame request_in_frame content_length",
    ),
    "tcp": _schema(
        "frame_number time_epoch captured_length frame_length ip_src ipv6_src source_port ip_dst ipv6_dst "
        "destination_port stream_index seq seq_raw payload_hex syn ack fin reset retransmission spurious "
        "out_of_order lost",
        "frame_number captured_length frame_length source_port destination_port stream_index seq seq_raw",
    ),
    "ftp": _schema(
        "frame_number time_epoch frame_length captured_length stream_index ip_src ipv6_src ip_dst ipv6_dst "
        "source_port destination_port tcp_len request_command request_argument response_code response_argument "
        "passive_ip passive_port setup_frame setup_method command_frame command",
        "frame_number frame_length captured_length stream_index source_port destination_port tcp_len "
        "response_code passive_port setup_frame command_frame",
    ),
    "telnet": _schema(
        "frame_number time_epoch frame_length captured_length stream_index ip_src ipv6_src ip_dst ipv6_dst "
        "source_port destination_port data",
        "frame_number frame_length captured_length stream_index source_port destination_port",
    ),
    "multipart": _schema("frame_number dispositions media_types", "frame_number"),
    "dns": _schema(
        "frame_number time_epoch ip_src ipv6_src ip_dst ipv6_dst stream_index query_name",
        "frame_number stream_index",
    ),
    "icmp": _schema(
        "frame_number time_epoch ip_src ip_dst ttl message_type code identifier sequence response_to",
        "frame_number ttl message_type code identifier sequence response_to",
    ),
    "urgent": _schema(
        "frame_number stream_index ip_src ipv6_src ip_dst ipv6_dst urgent pointer",
        "frame_number stream_index pointer",
    ),
    "usb": _schema("frame_number source destination endpoint report_hex", "frame_number"),
    "rtp": _schema(
        "frame_number time_epoch ip_src ipv6_src source_port ip_dst ipv6_dst destination_port ssrc payload_type "
        "seq timestamp payload_hex",
        "frame_number source_port destination_port payload_type seq timestamp",
    ),
    "tftp": _schema(
        "frame_number time_epoch ip_src ipv6_src ip_dst ipv6_dst source_port destination_port opcode source_file "
        "destination_file mode block request_frame error_code error_message option_name option_value payload_hex",
        "frame_number source_port destination_port opcode block request_frame error_code",
    ),
    "smtp": _schema(
        "frame_number stream_index ip_src ipv6_src ip_dst ipv6_dst source_port destination_port commands "
        "reassembled_length",
        "frame_number stream_index source_port destination_port reassembled_length",
    ),
}

# Columns a row must carry to be usable, per protocol.
REQUIRED: dict[str, list[str]] = {
    "inventory": ["frame_number", "time_epoch", "frame_length", "captured_length", "protocols"],
    "http": ["frame_number", "time_epoch", "stream_index", "source_port", "destination_port"],
    "tcp": ["frame_number", "time_epoch", "stream_index", "seq", "seq_raw"],
    "ftp": ["frame_number", "time_epoch", "stream_index"],
    "telnet": ["frame_number", "time_epoch", "stream_index", "source_port", "destination_port"],
    "multipart": ["frame_number"],
    "dns": ["frame_number", "query_name"],
    "icmp": ["frame_number", "time_epoch", "ip_src", "ip_dst", "ttl", "message_type", "code"],
    "urgent": ["frame_number", "stream_index", "pointer"],
    "usb": ["frame_number", "source", "report_hex"],
    "rtp": ["frame_number", "ssrc", "payload_type", "seq"],
    "tftp": ["frame_number", "source_port", "destination_port"],
    "smtp": ["frame_number", "stream_index"],
}
