"""Record types, as DDL. Unsigned numbers are widened; times are nanoseconds since 1970 in a long."""

PACKET = ("packet_id long, ts_nano long, length long, src_ip string, dst_ip string, src_port int, dst_port int, ip_proto int, tcp_flags int, payload binary")
FRAME = ("file string, packet_id long, ts_nano long, capture_length long, length long, link_type int, frame binary")
DECODED = ("ethertype int, ip_version int, src_ip string, dst_ip string, ip_proto int, ttl int, src_port int, dst_port int, tcp_flags int, seq long, ack long, window int, payload binary"
)
FLOW = ("flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, packets long, bytes long, start_nano long, end_nano long")
HOST = ("ip string, first_seen long, last_seen long, packet_count long, bytes_out long, bytes_in long")
DNS_RECORD = ("transaction_id int, is_response boolean, query_name string, query_type string, rcode string, answers array<struct<name:string,type:string,ttl:long,data:string>>, ttl long")
HTTP_REQUEST = ("method string, path string, version string, headers map<string,string>, host string, user_agent string, body binary")
HTTP_RESPONSE = ("version string, status int, reason string, headers map<string,string>, body binary")
CREDENTIAL = ("scheme string, username string, secret string")
TLS_HELLO = ("version int, ciphers array<int>, extensions array<int>, groups array<int>, point_formats array<int>, signature_algorithms array<int>, "
    "server_name string, alpn array<string>, supported_versions array<int>"
)
QUIC_HEADER = ("form string, packet_type string, version long, dcid string, scid string, token_length int, length long, supported array<long>")
SMB_HEADER = ("command int, status long, flags long, message_id decimal(20,0), tree_id long, session_id decimal(20,0), is_response boolean, body binary")
CARVED_FILE = ("extension string, mime string, category string, start long, size long, sha256 string, md5 string, dangerous boolean, threat boolean, file_name string")
PII_MATCH = ("type string, value string, start int, end int, confidence double")
ALERT = ("alert_id string, ts_nano long, source string, severity string, title string, description string, src_ip string, dst_ip string, score double")
