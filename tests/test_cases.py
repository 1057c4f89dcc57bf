"""The behaviours of the analysis, and its options."""

import pytest

from plumbline.engine.cases import CASES, told
from plumbline.engine.flow import Plugin


@pytest.mark.parametrize("name,text,expected", CASES, ids=[c[0] for c in CASES])
def test_case(name, text, expected):
    plugin = Plugin([("a.php", text)])
    assert told(plugin.findings) == expected
    assert plugin.status["converged"] and not plugin.status["errors"]


HANDLER = "<?php\nadd_action('wp_ajax_nopriv_x', 'first');\nfunction first(){ second(); }\nfunction second(){ echo $_GET['a']; }\nfunction third(){ echo $_GET['b']; }\n"


def test_entry_points_of_functions():
    points = lambda **o: [f["entry_point"] for f in Plugin([("a.php", HANDLER)], **o).findings]
    assert points() == ["ajax_nopriv"] * 2 and points(handler_entry=True) == ["ajax_nopriv", "unknown"]


def test_entry_points_reach_six_calls():
    chain = "<?php add_action('wp_ajax_nopriv_x', 'f0');" + "".join(f"function f{i}(){{ f{i + 1}(); }}" for i in range(9))
    reached = Plugin([("a.php", chain)]).entry_of
    assert set(reached) == {f"f{i}" for i in range(7)}


def test_presence_and_grading():
    text = "<?php\nfunction h(){ if(!current_user_can('x')){return;} save_it(); }\nfunction save_it(){ update_option('k', $_POST['k']); delete_option('j'); }"
    found = lambda **o: {f["vuln_class"]: (f["line"], f["sink"], f["confidence"], f["guard_deficit"]) for f in Plugin([("a.php", text)], **o).findings}
    assert found() == {"csrf": (3, "update_option", 0.5, 0.85)}
    assert found(graded=True) == {"csrf": (3, "update_option", 0.555, 0.85)}
    assert found(presence=True) == {"csrf": (3, "delete_option", 0.5, 0.85), "auth": (3, "delete_option", 0.5, 0.0)}
