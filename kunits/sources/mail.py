"""Readers of mail: messages (MIME) and message files (compound file with MAPI properties)."""

from __future__ import annotations

import email
import html
import re
import struct
from email import policy
from email.message import EmailMessage

from kunits.functions.decode import decode_bytes
from kunits.sources.archive import PackageError
from kunits.sources.office import Block

SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
TRACKING = r"(?i)unsubscribe|退订|取消订阅|tracking|view (this|in) (e-?mail|browser)|在浏览器中查看"
#: Property ids of a message file (fixed values).
PROPERTIES = {"0037": "subject", "0C1A": "from", "0E04": "to", "0E03": "cc", "1000": "body", "1035": "message_id", "007D": "headers"}
MOST_SECTORS = 1 << 20


def _safe(name: str) -> str:
    base = re.sub(r'[\x00-\x1f\x7f:*?"<>|]', "_", re.sub(r"^.*[\\/]", "", name or "")).strip(". ")
    return base[:180] or "attachment"


def _plain(markup: str) -> str:
    bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", markup)
    bare = re.sub(r"(?i)<br\s*/?>|</(p|div|tr|li|h[1-6])>", "\n", bare)
    return "\n".join(" ".join(line.split()) for line in html.unescape(re.sub(r"<[^>]*>", " ", bare)).splitlines() if line.strip())


def parse_message(data: bytes) -> dict:
    """subject, from, to, cc, date, message_id, body, attachments (name, type, bytes).

    Plain text goes before markup; images that the markup shows are left out;
    forwarded messages stay whole, as .eml.
    """
    message: EmailMessage = email.message_from_bytes(data, policy=policy.default)
    texts, markups, files, shown = [], [], [], set()

    def text_of(part: EmailMessage) -> str:
        raw = part.get_payload(decode=True) or b""
        try:
            return raw.decode(part.get_content_charset() or "utf-8")
        except (LookupError, UnicodeDecodeError):
            return decode_bytes(raw)[0] or raw.decode("utf-8", errors="replace")

    def walk(part: EmailMessage) -> None:
        kind, name = part.get_content_type(), part.get_filename()
        if kind == "message/rfc822":
            inner = part.get_payload(0)
            files.append((_safe(name or f"{inner.get('subject', 'message')}.eml") if (name or "").endswith(".eml") or not name else _safe(name + ".eml"), kind, inner.as_bytes()))
        elif part.is_multipart():
            for p in part.iter_parts():
                walk(p)
        elif part.get_content_disposition() == "attachment" or name and kind not in ("text/plain", "text/html"):
            cid = (part.get("Content-ID") or "").strip("<> ")
            files.append((_safe(name), kind, part.get_payload(decode=True) or b"", cid))
        elif kind == "text/plain":
            texts.append(text_of(part))
        elif kind == "text/html":
            markups.append(text_of(part))
            shown.update(re.findall(r"(?i)cid:([^\"'\s>]+)", markups[-1]))
        elif part.get_payload(decode=True):
            files.append((_safe(name), kind, part.get_payload(decode=True), (part.get("Content-ID") or "").strip("<> ")))

    walk(message)
    kept = [f[:3] for f in files if len(f) < 4 or not (f[3] and f[3] in shown and f[1].startswith("image/"))]
    head = lambda k: " ".join(str(message.get(k, "") or "").split())
    body = "\n".join(t.replace("\r\n", "\n").strip() for t in texts if t.strip()) or "\n".join(map(_plain, markups)).strip()
    return {**{k.replace("-", "_"): head(k) for k in ("subject", "from", "to", "cc", "date", "message-id")}, "body": body, "attachments": kept}


def message_blocks(message: dict) -> list[Block]:
    """The subject and the body may become knowledge; the rest of the envelope and the inventory may not."""
    mid = message.get("message_id", "")
    out = [Block("email_envelope", message["subject"], "header:subject", {"message_id": mid})] if message["subject"] else []
    out += [Block("email_envelope", f"{k}: {message[k]}", f"header:{k}", {"message_id": mid}, False, "envelope") for k in ("from", "to", "cc", "date") if message.get(k)]
    body = message["body"]
    if not body and message["attachments"]:
        body = "（正文为空，附件见清单）"
    for i, part in enumerate(p.strip() for p in re.split(r"\n\s*\n", body)):
        if part:
            odd = bool(re.search(TRACKING, part))
            out.append(Block("email_body", part, f"body:p={i + 1}", {"message_id": mid}, not odd, "tracking" if odd else ""))
    out += [Block("attachment", n, f"attachment:{i + 1}", {"message_id": mid, "media_type": t, "bytes": len(b)}, False, "inventory") for i, (n, t, b) in enumerate(message["attachments"])]
    return out


def read_eml(data: bytes) -> list[Block]:
    return message_blocks(parse_message(data))


class CompoundFile:
    """Streams of a compound file, by path. Chains are bounded, so loops end in an error."""

    def __init__(self, data: bytes, most: int = MOST_SECTORS):
        if data[:8] != SIGNATURE:
            raise PackageError("MSG_INVALID", "not a compound file")
        self.data, self.most = data, most
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        n_fat, first_dir = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
        self.cutoff, mini_first, _, di_first, di_count = struct.unpack_from("<5I", data, 56)
        tables = [s for s in struct.unpack_from("<109I", data, 76) if s < 0xFFFFFFFA][:n_fat]
        for _ in range(min(di_count, most)):
            if di_first >= 0xFFFFFFFA:
                break
            block = self._sector(di_first)
            entries = struct.unpack(f"<{len(block) // 4}I", block)
            tables += [s for s in entries[:-1] if s < 0xFFFFFFFA]
            di_first = entries[-1]
        self.fat = [x for s in tables for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        raw = self._chain(first_dir)
        self.entries = []
        for at in range(0, len(raw) - 127, 128):
            n = struct.unpack_from("<H", raw, at + 64)[0]
            left, right, child = struct.unpack_from("<3I", raw, at + 68)
            start, size = struct.unpack_from("<IQ", raw, at + 116)
            self.entries.append((raw[at : at + max(0, min(n, 64) - 2)].decode("utf-16-le", "replace"), raw[at + 66], left, right, child, start, size & 0xFFFFFFFF))
        if not self.entries:
            raise PackageError("MSG_INVALID", "no directory")
        self.mini = self._chain(self.entries[0][5])
        mini = self._chain(mini_first) if mini_first < 0xFFFFFFFA else b""
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini[: len(mini) // 4 * 4])
        self.streams: dict[str, int] = {}
        self._walk(self.entries[0][4], "")

    def _sector(self, n: int) -> bytes:
        block = self.data[(n + 1) * self.size : (n + 2) * self.size]
        if len(block) < self.size:
            raise PackageError("MSG_INVALID", "sector out of bounds")
        return block

    def _chain(self, n: int) -> bytes:
        out, seen = [], 0
        while n < 0xFFFFFFFA:
            seen += 1
            if seen > self.most or n >= len(self.fat):
                raise PackageError("MSG_LIMIT_EXCEEDED", "chain is too long or broken")
            out.append(self._sector(n))
            n = self.fat[n]
        return b"".join(out)

    def _walk(self, root: int, prefix: str) -> None:
        todo, seen = [(root, prefix)], set()
        while todo:
            n, before = todo.pop()
            if n >= len(self.entries) or n in seen:
                continue
            seen.add(n)
            name, kind, left, right, child, _, _ = self.entries[n]
            todo += [(left, before), (right, before)]
            if kind == 2:
                self.streams[before + name] = n
            elif kind in (1, 5):
                todo.append((child, f"{before}{name}/"))

    def read(self, path: str) -> bytes:
        *_, start, size = self.entries[self.streams[path]]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = [], 0
        while start < 0xFFFFFFFA and seen * self.mini_size < size:
            seen += 1
            if start >= len(self.mini_fat) or seen > self.most:
                raise PackageError("MSG_LIMIT_EXCEEDED", "chain is too long or broken")
            out.append(self.mini[start * self.mini_size : (start + 1) * self.mini_size])
            start = self.mini_fat[start]
        return b"".join(out)[:size]


def read_msg(data: bytes) -> list[Block]:
    """Blocks of a message file: envelope, body and inventory."""
    file = CompoundFile(data)
    found: dict[str, str] = {}
    names: list[tuple[str, str, bytes]] = []
    for path in sorted(file.streams):
        m = re.search(r"(?:^|/)__substg1\.0_([0-9A-F]{4})(001E|001F|0102)$", path)
        if not m:
            continue
        raw = file.read(path)
        text = raw.decode("utf-16-le", "replace") if m[2] == "001F" else (decode_bytes(raw)[0] or "") if m[2] == "001E" else ""
        if "__attach" in path:
            if m[1] == "3707":
                names.append((_safe(text.rstrip("\0")), "application/octet-stream", b""))
        elif m[1] in PROPERTIES and "__recip" not in path:
            found[PROPERTIES[m[1]]] = text.rstrip("\0")
    message = {k: found.get(k, "") for k in ("subject", "from", "to", "cc", "date", "message_id", "body")}
    return message_blocks({**message, "attachments": names})
