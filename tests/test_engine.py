"""The dataflow analysis: one case for each behaviour."""

import pytest

from plumbline.engine import scan
from plumbline.engine.flow import Plugin
from plumbline.engine.syntax import Parser

CASES = [
    ("<?php $q = $_GET['q']; echo \"<b>$q</b>\";", {"xss"}, {"sqli"}),
    ("<?php function show($v){ echo $v; } function page(){ show($_POST['t']); }", {"xss"}, set()),
    ("<?php function page(){ $a = esc_html($_GET['a']); echo $a; }", set(), {"xss"}),
    ("<?php function page(){ global $wpdb; $a = esc_html($_GET['a']); $wpdb->query(\"select \".$a); }", {"sqli"}, set()),
    ("<?php function page(){ global $wpdb; $wpdb->query( $wpdb->prepare('select %s', $_GET['a']) ); }", set(), {"sqli"}),
    ("<?php function f($c){ if($c){ $x=$_GET['x']; } else { $x='k'; } echo $x; }", {"xss"}, set()),
    ("<?php function f($c){ $x=$_GET['x']; if($c){ $x='a'; } else { $x='b'; } echo $x; }", set(), {"xss"}),
    ("<?php function f($c){ $x=$_GET['x']; if($c){ return; } echo $x; }", {"xss"}, set()),
    ("<?php function f($c){ if($c){ $x=$_GET['x']; return; } echo $x; }", set(), {"xss"}),
    ("<?php function a($v){ b($v); } function b($v){ c($v); } function c($v){ unlink($v); } function go(){ a($_REQUEST['p']); }", {"lfi"}, set()),
    ("<?php class K { public $d; function put(){ $this->d=$_POST['d']; } function out(){ print $this->d; } }", {"xss"}, set()),
    ("<?php class B { function s($v){ echo $v; } } class D extends B { function t(){ $this->s($_GET['z']); } }", {"xss"}, set()),
    ("<?php function m($v){ return n($v); } function n($v){ return m($v); } function go(){ echo m($_GET['x']); }", set(), set()),
    ("<?php add_action('wp_ajax_nopriv_put','put_it'); function put_it(){ update_option('k', $_POST['k']); }", {"csrf", "auth"}, set()),
    ("<?php function put_it(){ if(!current_user_can('edit')) { wp_die(); } check_admin_referer('n'); update_option('k', $_POST['k']); }", set(), {"csrf", "auth"}),
    ("<?php function put_it(){ if ( current_user_can('edit') ) { echo 1; } check_admin_referer('n'); update_option('k', $_POST['k']); }", {"auth"}, {"csrf"}),
    ("<?php function put_it(){ save_it(); } function save_it(){ update_option('k', $_POST['k']); } function h(){ check_ajax_referer('n'); if(!current_user_can('x')){return;} save_it(); }", {"csrf", "auth"}, set()),
    ("<?php array_map('trim', $_POST['xs']); array_map($_POST['fn'], array(1));", {"rce"}, set()),
    ("<?php echo htmlspecialchars_decode(esc_html($_GET['h']));", {"xss"}, set()),
    ("<?php unserialize($blob); unserialize($b2, ['allowed_classes'=>false]);", {"deserial"}, set()),
    ("<?php $r = get_option('tpl'); include $r;", {"lfi"}, {"xss"}),
    ("<?php foreach ($_GET['a'] as $k => $v) { echo $v; }", {"xss"}, set()),
    ("<?php $x = (int) $_GET['n']; echo $x; echo $_FILES['f']['tmp_name']; echo count($_GET);", set(), {"xss"}),
    ("<?php function f(){ $f = function() { echo $_GET['q']; }; }", {"xss"}, set()),
    ("<?php function r(){ return wp_unslash($_GET['q']); } function p(){ wp_redirect( r() ); }", {"other"}, {"xss"}),
    ("<?php function t($a){ return $a ? $_GET['x'] : 'y'; } echo t(1);", {"xss"}, set()),
    ("<?php switch ($m) { case 1: $x = $_GET['a']; break; default: $x = ''; } echo $x;", {"xss"}, set()),
]


@pytest.mark.parametrize("php,expected,silent", CASES)
def test_behaviour(php, expected, silent):
    plugin = Plugin([("a.php", php)])
    found = {f["vuln_class"] for f in plugin.findings}
    assert expected <= found and not silent & found
    assert plugin.status["converged"] and not plugin.status["errors"]


def test_order_of_files_does_not_matter():
    files = [("a.php", "<?php function page(){ echo clean($_GET['a']); show($_GET['b']); }"), ("b.php", "<?php function clean($v){ return esc_html($v); } function show($v){ echo $v; }")]
    keys = lambda p: sorted((f["file"], f["line"], f["vuln_class"], f["sink_file"]) for f in p.findings)
    assert keys(Plugin(files)) == keys(Plugin(files[::-1])) == [("a.php", 1, "xss", "b.php")]


def test_confidences_and_ranking(spark):
    php = "<?php\nadd_action( 'wp_ajax_nopriv_save', 'save' );\nfunction save() {\n $x = $_POST['x'];\n update_option( 'k', $x );\n echo $x;\n}"
    df = spark.createDataFrame([(1, "a.php", php), (1, "b.php", None), (2, "c.php", "no code"), (3, "d.php", "<?php if (")], "record_id long, path string, content string")
    rows = scan.ranked(scan.scan(df)).orderBy("rank").collect()
    assert [(r.vuln_class, r.line, r.score) for r in rows] == [("csrf", 5, 6.0), ("auth", 5, 6.0), ("xss", 6, 5.6)]
    assert {r.entry_point for r in rows} == {"ajax_nopriv"}
    off = scan.ranked(scan.scan(df), guard=0.0).orderBy("rank").first()
    assert off.vuln_class == "xss"
    told = {r.record_id: r for r in scan.status(df).collect()}
    assert told[1].converged and told[3].errors == 1 and told[2].findings == 0 and all(r.failed is None for r in told.values())


def test_recursion_ends_and_reports_its_cap():
    body = "".join(f"function f{i}($v){{ $this_{i} = $v; return f{(i + 1) % 40}($v) . $_GET['a{i}']; }}\n" for i in range(40))
    plugin = Plugin([("a.php", "<?php\n" + body)], cap=2)
    assert set(plugin.status) == {"converged", "updates", "rounds", "capped", "errors"}
    assert Plugin([("a.php", "<?php\n" + body)]).status["converged"]


@pytest.mark.parametrize("php", ["<?php if (", "<?php class A {", "<?php function f( {", "<?php $a = ;", "<?php try { a(); } catch (", "<?php match(", "<?php foreach ($a as", "<?php echo \"", "<?php new class { function x(", "<?php " + "(" * 400])
def test_damaged_code_ends(php):
    p = Parser(php)
    p.file()


LONG = "'args' => array(" + ", ".join(f"'f{i}' => array('type' => 'string', 'default' => ')')" for i in range(20)) + ")"
SAVE = " function save_items(){ update_option('k', $_POST['k']); } function page(){ check_admin_referer('n'); if(!current_user_can('x')){return;} save_items(); }"


@pytest.mark.parametrize("call,handlers,classes", [
    (f"register_rest_route('shop/v1','/items',array('methods'=>'POST',{LONG}, // don't: 'callback' => 'old'\n 'callback'=>'save_items'));", {"save_items"}, {"csrf", "auth"}),
    (f"register_rest_route('shop/v1','/items',[['methods'=>'GET','callback'=>[$this,'get_items']],[{LONG},'callback'=>[$this,'save_items'],'permission_callback'=>'__return_true']]);", {"get_items", "save_items"}, {"csrf", "auth"}),
    (f"register_rest_route('shop/v1','/items',array({LONG},'permission_callback'=>function(){{ return current_user_can('x'); }},'callback'=>'save_items'));", {"save_items"}, {"csrf"}),
    (f"add_action('wp_ajax_put', array( /* {'-' * 400} */ $this, 'save_items' ), 10);", {"save_items"}, {"csrf", "auth"}),
    ("add_shortcode('s', function(){ return 'x'; });", set(), set()),
])
def test_handlers_are_read_from_the_whole_call(call, handlers, classes):
    plugin = Plugin([("a.php", f"<?php {call}{SAVE}")])
    assert set(plugin.handlers) == handlers
    found = {f["vuln_class"]: f["guard_deficit"] for f in plugin.findings}
    assert set(found) == classes and set(found.values()) <= {1.0}


def test_admin_pages_are_gated():
    save = "function show(){ update_option('k', $_POST['k']); }"
    found = lambda call: {f["vuln_class"] for f in Plugin([("a.php", f"<?php {call} {save}")]).findings}
    assert found("add_menu_page('T','M','manage_options','slug','show','icon');") == {"csrf"} == found("add_submenu_page('p','T','M','manage_options','slug',array($this,'show'));")
    assert found("add_menu_page('T','M','manage_options','show');") == {"csrf", "auth"}
