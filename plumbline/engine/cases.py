"""Small plugins with what the analysis must tell of them: the behaviours that it promises, one by one."""

from __future__ import annotations

_SAVE = "function save_it(){ update_option('k', $_POST['k']); }"
_LONG = "'args' => array(" + ", ".join(f"'f{i}' => array('type' => 'string', 'default' => ')')" for i in range(20)) + ")"

#: (name, source, findings as class@line in order, parted by blanks)
CASES: tuple[tuple[str, str, str], ...] = (
    ("echo of a request value", "<?php $q = $_GET['q']; echo \"<b>$q</b>\";", "xss@1"),
    ("through a function's parameter", "<?php function show($v){ echo $v; }\nfunction page(){ show($_POST['t']); }", "xss@2"),
    ("sanitizer of the class", "<?php function page(){ $a = esc_html($_GET['a']); echo $a; }", ""),
    ("sanitizer of another class", "<?php function page(){ global $wpdb; $a = esc_html($_GET['a']); $wpdb->query(\"select \".$a); }", "sqli@1"),
    ("prepared statement", "<?php function page(){ global $wpdb; $wpdb->query( $wpdb->prepare('select %s', $_GET['a']) ); }", ""),
    ("tainted on one branch", "<?php function f($c){ if($c){ $x=$_GET['x']; } else { $x='k'; } echo $x; }", "xss@1"),
    ("overwritten on all branches", "<?php function f($c){ $x=$_GET['x']; if($c){ $x='a'; } else { $x='b'; } echo $x; }", ""),
    ("branch that returns", "<?php function f($c){ if($c){ $x=$_GET['x']; return; } echo $x; }", ""),
    ("three calls deep", "<?php function a($v){ b($v); }\nfunction b($v){ c($v); }\nfunction c($v){ unlink($v); }\nfunction go(){ a($_REQUEST['p']); }", "lfi@4"),
    ("property written and read in two methods", "<?php class K { public $d;\nfunction put(){ $this->d=$_POST['d']; }\nfunction out(){ print $this->d; } }", "xss@3"),
    ("inherited method", "<?php class B { function s($v){ echo $v; } }\nclass D extends B { function t(){ $this->s($_GET['z']); } }", "xss@2"),
    ("mutual recursion", "<?php function m($v){ return n($v); } function n($v){ return m($v); } function go(){ echo m($_GET['x']); }", ""),
    ("decoder undoes escaping", "<?php echo htmlspecialchars_decode(esc_html($_GET['h']));", "xss@1"),
    ("stored values for file classes alone", "<?php $r = get_option('tpl'); include $r; echo $r;", "lfi@1"),
    ("each element of a collection", "<?php foreach ($_GET['a'] as $k => $v) { echo $v; }", "xss@1"),
    ("casts, safe members, counts", "<?php $x = (int) $_GET['n']; echo $x; echo $_FILES['f']['tmp_name']; echo count($_GET);", ""),
    ("callback argument alone is a sink", "<?php array_map('trim', $_POST['xs']);\narray_map($_POST['fn'], array(1));", "rce@2"),
    ("ternary's values", "<?php function t($a){ return $a ? $_GET['x'] : 'y'; } echo t(1);", "xss@1"),
    ("source returned by a helper", "<?php function r(){ return wp_unslash($_GET['q']); }\nfunction p(){ wp_redirect( r() ); }", "other@2"),
    ("variable variable", "<?php $n = $_GET['n'];\necho $$n;", "xss@2"),
    ("variable variable of a constant name", "<?php $n = 'title';\necho $$n;", ""),
    ("database handle behind a property", "<?php class M { function g(){ return $this->db->query('x ' . $_GET['i']); } }", "sqli@1"),
    ("feedback is no database", "<?php class M { function g(){ return $this->feedback->query('x ' . $_GET['i']); } }", ""),
    ("receiver of one known class", "<?php class P { function show($v){ echo $v; } }\nfunction f(){ $p = new P; $p->show($_GET['x']); }", "xss@2"),
    ("receiver assigned from elsewhere", "<?php class P { function show($v){ echo $v; } }\nfunction f($q){ $p = new P; $p = make($q); $p->show($_GET['x']); }", ""),
    ("receiver of a declared class and its descendants", "<?php class P { function show($v){} }\nclass Q extends P { function show($v){ echo $v; } }\nfunction f(P $p){ $p->show($_GET['x']); }", "xss@3"),
    ("receiver of a union type", "<?php class P { function show($v){ echo $v; } }\nfunction f(P|string $p){ $p->show($_GET['x']); }", ""),
    ("own function in a namespace before the global one", "<?php namespace A; function esc_html($v){ return $v; }\necho esc_html($_GET['x']);", "xss@2"),
    ("global function from a namespace", "<?php namespace A; echo \\esc_html($_GET['x']);", ""),
    ("qualified name is no framework function", "<?php namespace A; echo B\\esc_html($_GET['x']);", "xss@1"),
    ("shortcode callback returns its input", "<?php add_shortcode('s', 'render');\nfunction render($atts){ return '<b>' . $atts['t'] . '</b>'; }", "xss@2"),
    ("shortcode callback puts markup together", "<?php add_shortcode('s', array('K', 'render'));\nclass K { static function render($atts){\n$h = '<b>' . $atts['t'];\nreturn $h; } }", "xss@3"),
    ("shortcode callback escapes", "<?php add_shortcode('s', 'render');\nfunction render($atts){ return '<b>' . esc_html($atts['t']) . '</b>'; }", ""),
    ("block callback", "<?php register_block_type('a/b', array('render_callback' => 'render'));\nfunction render($a){ return \"<i>{$a['x']}</i>\"; }", "xss@2"),
    ("two functions of the registered name", "<?php add_shortcode('s', 'render');\nif ($a) { function render($atts){ return '<b>' . $atts['t']; } } else { function render($atts){ return '<b>' . $atts['t']; } }", ""),
    ("callback of an unknown object", "<?php add_shortcode('s', array($handler, 'render'));\nclass K { function render($atts){ return '<b>' . $atts['t']; } }", ""),
    ("embed callback fetches its address", "<?php wp_embed_register_handler('e', '#x#', 'show');\nfunction show($m, $a, $url){ return wp_remote_get($url); }", "ssrf@2"),
    ("stored field value", "<?php class F extends acf_field { function render_field($field){\necho $field['value'];\necho $field['label']; } }", "xss@2"),
    ("unguarded handler", "<?php add_action('wp_ajax_nopriv_put','save_it');\n" + _SAVE, "csrf@2 auth@2"),
    ("guards before the change", "<?php function put_it(){ if(!current_user_can('edit')) { wp_die(); } check_admin_referer('n'); update_option('k', $_POST['k']); }", ""),
    ("guard on another branch", "<?php function put_it(){ if ( current_user_can('edit') ) { echo 1; } check_admin_referer('n'); update_option('k', $_POST['k']); }", "auth@1"),
    ("every caller is guarded", "<?php function h(){ check_ajax_referer('n'); if(!current_user_can('x')){return;} save_it(); }\n" + _SAVE, ""),
    ("one caller is not", "<?php function g(){ save_it(); } function h(){ check_ajax_referer('n'); if(!current_user_can('x')){return;} save_it(); }\n" + _SAVE, "csrf@2 auth@2"),
    ("public route with long arguments", f"<?php register_rest_route('s/v1','/i',array('methods'=>'POST',{_LONG},'callback'=>'save_it','permission_callback'=>'__return_true'));\n{_SAVE}", "csrf@2 auth@2"),
    ("route with a permission callback", f"<?php register_rest_route('s/v1','/i',array({_LONG},'callback'=>'save_it','permission_callback'=>'may_save'));\n{_SAVE}", "csrf@2"),
    ("page of the admin menu", "<?php add_menu_page('T','M','manage_options','slug','save_it','icon');\n" + _SAVE, "csrf@2"),
)


def told(findings: list[dict]) -> str:
    return " ".join(f"{f['vuln_class']}@{f['line']}" for f in findings)
