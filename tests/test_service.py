import json
import threading
import urllib.error
import urllib.request

import pytest

from codeweave import service


class FakeTools:
    def parse_repo(self, repo, project, progress=None, **options):
        progress("discover")
        if repo == "bad":
            raise ValueError("no")
        return {"status": "completed", "project": project, **{k: options[k] for k in ("clean", "incremental")}}


@pytest.fixture
def url():
    s = service.server(FakeTools())
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def ask(url, body=None):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body)) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_service(url):
    assert ask(url + "/health") == (200, {"status": "ok"}) and ask(url + "/x")[0] == 404 and ask(url + "/x", b"{}")[0] == 404
    assert ask(url + "/parse", b"{")[0] == 400 and ask(url + "/parse", b"{}")[0] == 400 and ask(url + "/parse", b"[]")[0] == 400
    assert ask(url + "/parse", b'{"repo": "https://h/a/b.git"}') == (200, {"status": "completed", "project": "b", "clean": True, "incremental": False})
    assert ask(url + "/parse", b'{"repo": "r", "project": "p", "incremental": true, "progress_url": "http://127.0.0.1:9/"}') == (200, {"status": "completed", "project": "p", "clean": False, "incremental": True})
    assert ask(url + "/parse", b'{"repo": "bad"}')[0] == 500
    assert not service.report_completion("http://127.0.0.1:9/", {}, pause=0) and not service.report_completion(None, {})
