"""Code by hand for each built-in rule: what it finds, and what is nearly that.

An example is code of one or more lines, the rules that find something in it (``rule``, ``rule@line`` or ``rule@first-last``, lines
from 1; a rule without a line spans all lines), and the rules that nearly do. No other rule of the language finds anything in it."""

from __future__ import annotations

#: What a file of a language begins with.
HEADS = {"typescript": "", "javascript": "", "java": "", "python": "", "go": "package p", "csharp": "", "kotlin": "", "ruby": "", "php": "<?php"}

_TS = [
    ('authorize("orders:read");', "ts-authorize-function-call", ""),
    ('authorize(\n  "orders:read",\n  user,\n);', "ts-authorize-function-call", ""),
    ("authorize(orderPermission);", "", "ts-authorize-function-call"),
    ('authorizeAll("orders:read");', "", "ts-authorize-function-call"),
    ("const d = await avp.isAuthorizedWithToken({ token });", "ts-aws-verified-permissions", ""),
    ("verifiedPermissions.isAuthorized(input);", "ts-aws-verified-permissions ts-session-auth-check", ""),
    ("client.isAuthorizedWithToken(input);", "", "ts-aws-verified-permissions ts-session-auth-check"),
    ("app.use(authorizationMiddleware(engine));", "ts-cedar-express-middleware", "ts-express-auth-middleware"),
    ("app.mount(authorizationMiddleware(engine));", "", "ts-cedar-express-middleware"),
    ("allowed = can(user).edit.post(draft);", "ts-chained-permission-call", ""),
    ("allowed = load(user).edit.post(draft);\ncan(user).edit(draft);", "", "ts-chained-permission-call"),
    ("router.use(ensureLoggedIn);", "ts-express-auth-middleware", ""),
    ("router.use(bodyParser);", "", "ts-express-auth-middleware"),
    ('router.post("/orders",\n  requireRole,\n  createOrder);', "ts-express-route-middleware", ""),
    ('router.post("/orders", createOrder, next);\nrouter.post("/orders", requireRole);', "", "ts-express-route-middleware"),
    ('if (account.tier !== "free") {\n  upsell();\n}', "ts-feature-gate-check", ""),
    ('if (account.tier) { upsell(); }\nconst paid = account.tier !== "free";', "", "ts-feature-gate-check"),
    ("requireRole('auditor', user);", "ts-has-role-call", ""),
    ('const line = `as ${hasRole("in a template")}, not hasRole("in text")`;', "ts-has-role-call", ""),
    ("hasRole(role);\nuser.hasRole('admin');", "", "ts-has-role-call"),
    ("if (roles.includes('ops')) { open(); }", "ts-identifier-includes-check@1", ""),
    ('names.includes("ops");\nroles.push("ops");', "", "ts-identifier-includes-check"),
    ("const t = jose.sign(claims);", "ts-jwt-sign-issue", ""),
    ("canvas.sign(claims);\njwt.sign();", "", "ts-jwt-sign-issue"),
    ("const c = jwt.decode(t, { complete: true });", "ts-jwt-verify-decode", ""),
    ("jwt.parse(t);", "", "ts-jwt-verify-decode"),
    ('team.isOrgOwner("org-1");', "ts-membership-check-call", ""),
    ("team.isOrgOwner(org);", "", "ts-membership-check-call"),
    ('class C {\n  @Roles("ops")\n  list() {}\n}', "ts-nestjs-roles-decorator@2", ""),
    ('class C { @Role("ops") list() {} }', "", "ts-nestjs-roles-decorator"),
    ("@UseGuards(JwtGuard, RolesGuard)\nclass C {}", "ts-nestjs-use-guards@1", ""),
    ("@UsePipes(JwtGuard)\nclass C {}", "", "ts-nestjs-use-guards"),
    ("const mine = doc.createdBy == req.userId;", "ts-ownership-check", ""),
    ("f(doc.ownerId !== user.id);\ng(user.id === doc.ownerId);", "", "ts-ownership-check"),
    ('acl.isAllowed("user", "doc");', "ts-permission-check-call", ""),
    ("acl.isAllowed(user);", "", "ts-permission-check-call"),
    ('if (member.userType != "guest") { go(); } else { stop(); }', "ts-role-check-conditional", ""),
    ('if (message.role === "assistant") { go(); }\nconst admin = user.role === "admin";\nif (a && user.role === "admin") { go(); }', "", "ts-role-check-conditional"),
    ('const yes = user.roles.some("admin");', "ts-role-includes-check", ""),
    ('user.tags.includes("admin");', "", "ts-role-includes-check"),
    ("if (!req.isAuthenticated()) { deny(); }", "ts-session-auth-check@1", ""),
    ("req.authenticate();", "", "ts-session-auth-check"),
    ("export const list = protectedProcedure.input(schema);", "ts-trpc-procedure", ""),
    ("Procedure.input(schema);", "", "ts-trpc-procedure"),
    ("// hasRole('a')\n/* authorize('b')\n   hasRole('c') */ const s = \"hasRole('d')\";", "", "ts-has-role-call ts-authorize-function-call"),
]

_JAVA = [
    ("class V extends AbstractSecurityInterceptor {\n}", "java-access-decision-voter", ""),
    ("class P implements PermissionEvaluator, Other { }", "java-access-decision-voter", ""),
    ("class P implements Evaluator { }", "", "java-access-decision-voter"),
    ("class A {\n  void f() {\n    token.isFullyAuthenticated();\n  }\n}", "java-authenticated-check@3", ""),
    ("class A { void f() { token.isReady(); } }", "", "java-authenticated-check"),
    ('class A { @Authorized("Edit") void f() { } }', "java-authorized-annotation", ""),
    ('class A {\n  @Authorized({\n    "View"\n  })\n  void f() { }\n}', "java-authorized-annotation@2-4", ""),
    ("class A { @Authorized void f() { } }", "", "java-authorized-annotation"),
    ("class A { void f() { avp.isAuthorizedWithToken(r); } }", "java-aws-verified-permissions java-custom-authz-call", "java-cedar-eval"),
    ("class A { void f() { cedar.isAuthorized(p, a, r); } }", "java-cedar-eval java-custom-authz-call", "java-aws-verified-permissions"),
    ("class A { void f() { gate.isAuthorized(r); } }", "java-custom-authz-call", "java-aws-verified-permissions java-cedar-eval"),
    ("class A { void f() { if (org.canManageAccess(u)) { } } }", "java-custom-authz-call", ""),
    ("class A { void f() { u.isProjectReady(); } boolean isOrgAdmin(User u) { return true; } }", "", "java-custom-authz-call"),
    ("class A { void f() { flags.isFeatureEnabled(Flags.BETA); } }", "java-feature-gate-check", ""),
    ("class A { void f() { flags.isFeatureEnabled(name()); } }", "", "java-feature-gate-check"),
    ('class A { void f() { http.hasAnyAuthority("A", "B"); } }', "java-has-role-call", "java-custom-authz-call"),
    ("class A { void f() { http.hasRole(roleOf(u)); } }", "", "java-has-role-call java-custom-authz-call"),
    ("class A { void f() { http.oauth2Login(c); } }", "java-http-security-authorize", ""),
    ("class A { void f() { http.csrf(c); } }", "", "java-http-security-authorize"),
    ("class A { void f() { request.isUserInRole(Roles.OPS); } }", "java-is-user-in-role", ""),
    ("class A { void f() { request.isUserInRole(pick()); } }", "", "java-is-user-in-role"),
    ('class A {\n  @Path("/x")\n  @DELETE\n  void f() { }\n}', "java-jaxrs-endpoint@2 java-jaxrs-endpoint@3", ""),
    ("class A { @Get void f() { } }", "", "java-jaxrs-endpoint"),
    ("class A { boolean f() { return a.getOwnerId().equals(b.getId()); } }", "java-ownership-check", ""),
    ("class A { boolean f() { return a.getId().equals(b.getId()); } boolean g() { return a.getName().equals(b.getOwnerId()); } }", "", "java-ownership-check"),
    ('class A { boolean f() { return u.getAuthority().equalsIgnoreCase("ops"); } }', "java-role-equals-check", ""),
    ('class A { boolean f() { return u.getName().equals("ops"); } }', "", "java-role-equals-check"),
    ("class S implements WebSecurityConfigurer<X> { }", "java-security-interface-impl", ""),
    ("class S implements a.b.UserDetailsService {\n  void f() { }\n}", "java-security-interface-impl", ""),
    ("class S implements Serializable { }", "", "java-security-interface-impl"),
    ("class A { void f() { subject.checkPermissions(Perm.A); } }", "java-shiro-is-permitted", ""),
    ("class A { void f() { subject.isPermitted(perm()); } }", "", "java-shiro-is-permitted"),
    ("class A { @RequiresUser void f() { } }", "java-shiro-requires-authentication", ""),
    ('class A { @RequiresUser("x") void f() { } }', "", "java-shiro-requires-authentication"),
    ('class A {\n  @RequiresPermissions(\n    "doc:write")\n  void f() { }\n}', "java-shiro-requires-permissions@2-3", ""),
    ("class A { @RequiresPermissions(P.WRITE) void f() { } }", "", "java-shiro-requires-permissions"),
    ('class A { @RequiresRoles({"a"}) void f() { } }', "java-shiro-requires-roles-array", "java-shiro-requires-roles"),
    ('class A { @RequiresRoles("a") void f() { } }', "java-shiro-requires-roles", "java-shiro-requires-roles-array"),
    ("class A { @DenyAll void f() { } }", "java-spring-permit-all", ""),
    ("class A { @PermitSome void f() { } }", "", "java-spring-permit-all"),
    ('class A { @org.sec.PreAuthorize("isAuthenticated()") void f() { } }', "java-spring-preauthorize", "java-authenticated-check"),
    ('class A { @PostAuthorize("x") void f() { } }', "", "java-spring-preauthorize"),
    ('class A { @RolesAllowed({"a", "b", "c"}) void f() { } }', "java-roles-allowed-array", "java-roles-allowed"),
    ('class A { @RolesAllowed("ops") void f() { } }', "java-roles-allowed", "java-roles-allowed-array"),
    ("class A { @RolesAllowed({A, B}) void f() { } @RolesAllowed(OPS) void g() { } }", "", "java-roles-allowed-array java-roles-allowed"),
    ('class A { @Secured("ROLE_OPS") void f() { } }', "java-spring-secured", ""),
    ('class A { @Secured({"ROLE_OPS"}) void f() { } }', "", "java-spring-secured"),
    ('// @RolesAllowed("a")\nclass A { String s = "@RolesAllowed(1)"; char c = \'"\'; }', "", "java-roles-allowed"),
]

_PY = [
    ("verified_permissions.is_authorized_with_token(t)", "py-aws-verified-permissions", ""),
    ("gate.is_authorized_with_token(t)", "", "py-aws-verified-permissions"),
    ("check_stream_write_access(s, user)", "py-check-helper-call", ""),
    ("check_balance(user)\nobj.check_can_edit(user)", "", "py-check-helper-call"),
    ('@auth.permission_required("app.add")\ndef f(r):\n    return 1', "py-django-permission-required@1", ""),
    ("@permission_required(PERM)\ndef f(r):\n    return 1", "", "py-django-permission-required"),
    ("@decorators.user_passes_test(lambda u: u.ok)\ndef f(r):\n    return 1", "py-django-user-passes-test@1", ""),
    ("g = user_passes_test(f)", "", "py-django-user-passes-test"),
    ("def f(db=Depends(get_db)):\n    return 1", "py-fastapi-depends@1", ""),
    ("async def f(\n    a: int,\n    db: Db = Depends(get_db),\n) -> int:\n    return 1", "py-fastapi-depends@3", ""),
    ("def f(db=Body(get_db)):\n    return 1", "", "py-fastapi-depends"),
    ('flags.has_feature("beta")', "py-feature-gate-check", ""),
    ('flags.has_feature(name)\nx = org.plan != "pro"', "", "py-feature-gate-check"),
    ('user.has_perms(["app.add", "app.change"])', "py-has-perm-call", ""),
    ("user.has_perm(perm)", "", "py-has-perm-call"),
    ('require_role("ops")', "py-has-role-call", ""),
    ("s = f\"{has_role('in braces')!r:>{w}} {{has_role('in text')}}\"", "py-has-role-call", ""),
    ('require_role(role)\nuser.has_role("ops")', "", "py-has-role-call"),
    ('@login_required(login_url="/in")\ndef f(r):\n    return 1', "py-login-required-decorator@1", ""),
    ("@login_optional\ndef f(r):\n    return 1", "", "py-login-required-decorator"),
    ("mine = doc.created_by == request.user_id", "py-ownership-check", ""),
    ("mine = doc.owner_id != user.id\nmine = owner_id == user.id", "", "py-ownership-check"),
    ('acl.is_allowed(\n    "edit",\n)', "py-permission-check-call", ""),
    ("acl.is_allowed(action)", "", "py-permission-check-call"),
    ("@decorators.require_org_admin(level=2)\ndef f(r):\n    return 1", "py-require-decorator@1", ""),
    ("@require_POST\ndef f(r):\n    return 1", "", "py-require-decorator"),
    ('if user.account_type is "staff":\n    go()', "py-role-check-conditional@1", ""),
    ('if m.role == "assistant":\n    go()\nx = user.role != "admin"', "", "py-role-check-conditional"),
    ('"""has_role("a")\n@login_required\n"""\n# has_role("b")', "", "py-has-role-call py-login-required-decorator"),
]

_GO = [
    ("func f() { d := b.WithTenant(t) }", "go-access-descriptor-builder", ""),
    ("func f() { d := b.WithTimeout(t) }", "", "go-access-descriptor-builder"),
    ("func f() { r, err := avp.IsAuthorized(ctx, in) }", "go-aws-verified-permissions", "go-cedar-eval"),
    ("func f() { r, err := client.IsAuthorizedWithToken(ctx, in) }", "", "go-aws-verified-permissions"),
    ("func f() { ok, err := e.EnforceEx(sub, obj, act) }", "go-casbin-enforce", ""),
    ("func f() { ok := e.EnforceLater(sub) }", "", "go-casbin-enforce"),
    ("func f() { ok, _ := policySet.IsAuthorized(e, r) }", "go-cedar-eval", "go-aws-verified-permissions"),
    ("func f() { ok := gate.IsAuthorized(e, r) }", "", "go-cedar-eval"),
    ("func f() { ok := FlagEnabled(`beta`) }", "go-feature-gate-check", ""),
    ("func f() { ok := flags.IsEnabled(name) }", "", "go-feature-gate-check"),
    ("func f() { r.Use(middleware.JWTAuth) }", "go-gin-auth-middleware", ""),
    ("func f() { r.Use(gin.Logger()) }", "", "go-gin-auth-middleware"),
    ("func f(u User) error {\n\tif u.HasAnyRole(`ops`) {\n\t\treturn nil\n\t}\n\treturn err\n}", "go-has-role-call@2", ""),
    ('func f() { ok := HasRole(role) }\nfunc HasRole(r string) bool { return r == "x" }', "", "go-has-role-call"),
    ("func f() {\n\tq := rego.New(\n\t\trego.Query(s),\n\t)\n}", "go-opa-rego-eval@2-4", ""),
    ("func f() { q := bundle.New(s) }", "", "go-opa-rego-eval"),
    ("func f() { ok := doc.CreatedBy == u.ID }", "go-ownership-check", ""),
    ("func f() { ok := a.ID == b.ID || doc.OwnerID != u.ID }", "", "go-ownership-check"),
    ('func f() { ok := Can("edit") }', "go-permission-check-call", ""),
    ("func f() { ok := user.Can(action) }", "", "go-permission-check-call"),
    ("func f() {\n\tif u.CanEditPosts() && n > 1 {\n\t\tx()\n\t}\n}", "go-permission-predicate-call@2", ""),
    ("func f() { u.Cancel() }", "", "go-permission-predicate-call"),
    ("func f() { ok := u.UserType == `staff` }", "go-role-check-conditional", ""),
    ("func f() { switch { case u.Role == \"admin\":\n\tx()\n} }", "go-role-check-conditional@1", ""),
    ('func f() { ok := u.Role != "admin" }', "", "go-role-check-conditional"),
    ('// HasRole("a")\nvar s = `HasRole("b")\nit\'s`', "", "go-has-role-call"),
]

_CS = [
    ("class A {\n  [AllowAnonymous]\n  void F() { }\n}", "csharp-aspnet-allow-anonymous@2", ""),
    ("class A { [AllowSome] void F() { } }", "", "csharp-aspnet-allow-anonymous"),
    ("class A { [Authorize, Other] void F() { } }", "csharp-aspnet-authorize-attribute", ""),
    ('class A { [Authorize(AuthenticationSchemes = "x")] void F() { } }', "", "csharp-aspnet-authorize-attribute csharp-aspnet-authorize-policy-shorthand"),
    ('class A { [AuthorizeAttribute("Ops")] void F() { } }', "csharp-aspnet-authorize-policy-shorthand", "csharp-aspnet-authorize-attribute csharp-aspnet-authorize-policy"),
    ("class A { [Authorize(Policies.Ops)] void F() { } }", "", "csharp-aspnet-authorize-policy-shorthand"),
    ('class A {\n  [Authorize(AuthenticationSchemes = "b",\n    Policy = "Ops")]\n  void F() { }\n}', "csharp-aspnet-authorize-policy@2-3", "csharp-aspnet-authorize-roles"),
    ("class A { [Authorize(Policy = Policies.Ops)] void F() { } }", "", "csharp-aspnet-authorize-policy"),
    ('class A { [Authorize(Roles = "Ops")] void F() { } }', "csharp-aspnet-authorize-roles", "csharp-aspnet-authorize-policy"),
    ("class A { [Authorize(Roles = Names.Ops)] void F() { } }", "", "csharp-aspnet-authorize-roles"),
    ("class A { void F() { app.MapPost(a, b).AllowAnonymous(); } }", "csharp-aspnet-endpoint-allow-anonymous", ""),
    ("class A { void F() { app.AllowAnonymousLater(); } }", "", "csharp-aspnet-endpoint-allow-anonymous"),
    ('class A { void F() { group.RequireAuthorization("Ops"); } }', "csharp-aspnet-require-authorization", ""),
    ('class A { void F() { group.RequireHost("x"); } }', "", "csharp-aspnet-require-authorization"),
    ("class A { async void F() { await auth.AuthorizeAsync(User, doc, Operations.Edit); } }", "csharp-authorization-service-authorize-async", ""),
    ("class A { async void F() { await auth.AuthorizeAsync(User, doc); } }", "", "csharp-authorization-service-authorize-async"),
    ("class A { void F() { avp.IsAuthorizedWithTokenAsync(r); } }", "csharp-aws-verified-permissions", ""),
    ("class A { void F() { api.IsAuthorizedAsync(r); } }", "", "csharp-aws-verified-permissions"),
    ('class A { void F() { User.HasClaim(ClaimTypes.Dept, "hr"); } }', "csharp-has-claim-call", ""),
    ('class A { void F() { User.HasClaim(c => c.Type == "x"); } }', "", "csharp-has-claim-call"),
    ("class A { void F() { User.IsInRole(Roles.Ops); } }", "csharp-is-in-role-call", ""),
    ('class A {\n  string F() {\n    return $"is {User.IsInRole("Ops")} {{IsInRole}}";\n  }\n}', "csharp-is-in-role-call@3", ""),
    ("class A { void F() { User.IsInRole(GetRole()); } bool IsInRole(string r) => true; }", "", "csharp-is-in-role-call"),
    ("// [Authorize]\nclass A { string s = @\"[Authorize] \"\"x\"\"\"; }", "", "csharp-aspnet-authorize-attribute"),
]

_KT = [
    ("fun f() { http.hasAnyAuthority(Roles.OPS) }", "kotlin-has-role-call", ""),
    ('val line = "is ${user.hasRole("admin")} $name"', "kotlin-has-role-call", ""),
    ("fun f() { http.hasRole(pick()) }\nfun hasRole(r: String) = true", "", "kotlin-has-role-call"),
    ('fun f() {\n    authenticate("jwt") {\n        get("/a") { }\n    }\n}', "kotlin-ktor-authenticate-block@2", ""),
    ('fun f() { authenticate { get("/a") { } } }', "kotlin-ktor-authenticate-block", ""),
    ('fun f() { authorizeAll { } }\nfun g() { x.authenticate("jwt") }', "", "kotlin-ktor-authenticate-block"),
    ("fun f() {\n    install(Sessions)\n}", "kotlin-ktor-install-authentication@2", ""),
    ("fun f() { install(CallLogging) }", "", "kotlin-ktor-install-authentication"),
    ('val ok = user.permissions.contains("edit")', "kotlin-role-collection-contains", ""),
    ('val ok = user.names.contains("edit")\nval no = roles.contains("x")', "", "kotlin-role-collection-contains"),
    ('val x = user.authority == "ops"', "kotlin-role-equals-check", ""),
    ('val x = user.role != "ops"\nval y = role == "ops"', "", "kotlin-role-equals-check"),
    ('@javax.RolesAllowed("a")\nfun f() { }', "kotlin-roles-allowed@1", ""),
    ("@RolesAllowed(A)\nfun f() { }", "", "kotlin-roles-allowed"),
    ('@PreAuthorize("isAuthenticated()")\nclass C', "kotlin-spring-preauthorize@1", ""),
    ('@PostAuthorize("x") fun f() { }', "", "kotlin-spring-preauthorize"),
    ('@Secured("A") fun f() { }', "kotlin-spring-secured", ""),
    ('@Securely("A") fun f() { }', "", "kotlin-spring-secured"),
    ('// user.hasRole("a")\nval s = """user.hasRole("b")\nit\'s"""', "", "kotlin-has-role-call"),
]

_RB = [
    ("@user.cannot?(:edit, doc)", "ruby-cancancan-can-check", ""),
    ('puts "may: #{current_user.can?(:edit, doc)}"', "ruby-cancancan-can-check", ""),
    ('post.can?(:edit)\nuser.can?("edit")', "", "ruby-cancancan-can-check"),
    ("cannot :destroy, Comment", "ruby-cancancan-can-declaration", ""),
    ("can :manage, :all", "", "ruby-cancancan-can-declaration"),
    ("stop if member.moderator?", "ruby-current-user-role-predicate", ""),
    ("post.admin?\nuser.admin", "", "ruby-current-user-role-predicate"),
    ("authorize! post, :show?", "ruby-pundit-authorize", ""),
    ("sql = <<~SQL\n  it's authorize @no\nSQL\nauthorize Post", "ruby-pundit-authorize@4", ""),
    ("authorize :dashboard\nform.authorize @post", "", "ruby-pundit-authorize"),
    ("class DocPolicy < Base::RecordPolicy\n  def show?\n    true\n  end\nend", "ruby-pundit-policy-class", ""),
    ("class DocPolicy < Record\nend", "", "ruby-pundit-policy-class"),
    ("policy(@doc).destroy?", "ruby-pundit-policy-method", ""),
    ("policy(@doc).scope\nhelper(@doc).show?", "", "ruby-pundit-policy-method"),
    ("skip_before_action :verify_token, only: :index", "ruby-rails-before-action-filter", ""),
    ("before_action :set_post", "", "ruby-rails-before-action-filter"),
    ("account.permissions.include?(:edit)", "ruby-role-collection-include", ""),
    ("words = %w(it's fine)\nuser.roles.include?('ops')", "ruby-role-collection-include@2", ""),
    ('account.names.include?(:edit)\nroles.include?("x")', "", "ruby-role-collection-include"),
    ("x = account.user_type == :staff", "ruby-role-equals-check", ""),
    ('x = user.role != "admin"\ny = role == "x"', "", "ruby-role-equals-check"),
    ("# authorize @post\ns = 'authorize @post'", "", "ruby-pundit-authorize"),
]

_PHP = [
    ('$u->hasPermissionTo("edit posts");', "php-has-role-call", ""),
    ('$line = "is {$u->hasRole(\'ops\')} $name";', "php-has-role-call", ""),
    ("$u->hasRole($role);\nUser::hasRole('x');", "", "php-has-role-call"),
    ('if (in_array("ops", $u->permissions)) { go(); }', "php-in-array-role-check", ""),
    ("in_array('ops', $names);", "", "php-in-array-role-check"),
    ("$request->user()->can('edit', $p);", "php-laravel-authorize-helper", ""),
    ("$user?->cannot('edit');", "php-laravel-authorize-helper", ""),
    ("$mailer->can('send');", "", "php-laravel-authorize-helper"),
    ("Gate::denies('edit', $p);", "php-laravel-gate-allows-denies", "php-laravel-gate-define"),
    ("Door::allows('edit');", "", "php-laravel-gate-allows-denies"),
    ('Gate::define("edit", fn($u) => true);', "php-laravel-gate-define", "php-laravel-gate-allows-denies"),
    ("Gate::before($f);", "", "php-laravel-gate-define"),
    ("class DocPolicy {\n  public function view($u) { return true; }\n  public function helper() { }\n}", "php-laravel-policy-class@2", ""),
    ("class DocHelper { public function view($u) { return true; } }", "", "php-laravel-policy-class"),
    ("Route::get('/a', $f)->middleware(['auth:api', 'throttle']);", "php-laravel-route-middleware", ""),
    ("Route::middleware('throttle');", "", "php-laravel-route-middleware"),
    ('if ($u->user_role == "ops") {\n  go();\n}', "php-role-equals-check@1", ""),
    ("$a = $u->role != 'ops';\n$b = $role === 'ops';", "", "php-role-equals-check"),
    ('class A {\n  #[IsGranted("ROLE_OPS")]\n  public function f() { }\n}', "php-symfony-is-granted-attribute@2", ""),
    ("class A { #[Granted('X')] public function f() { } }", "", "php-symfony-is-granted-attribute"),
    ('$this->denyAccessUnlessGranted("edit", $p);', "php-symfony-is-granted", ""),
    ("$this->isGranted($attr);", "", "php-symfony-is-granted"),
    ("class DocVoter extends \\App\\BaseVoter {\n}", "php-symfony-voter-class", ""),
    ("class Doc extends Model { }", "", "php-symfony-voter-class"),
    ("$t = <<<EOT\nit's $u->hasRole('ops')\nEOT;\n?> it's <p><?= $u->hasRole('ops') ?> don't <?php", "php-has-role-call@4", ""),
    ("// $u->hasRole('ops')\n$s = '$u->hasRole(1)';", "", "php-has-role-call"),
]

EXAMPLES = {"typescript": _TS, "java": _JAVA, "python": _PY, "go": _GO, "csharp": _CS, "kotlin": _KT, "ruby": _RB, "php": _PHP}
#: JavaScript has TypeScript's examples; the rules for decorators are TypeScript's alone.
TYPESCRIPT_ONLY = ("ts-nestjs-roles-decorator", "ts-nestjs-use-guards")


def hits(code: str, found: str) -> list[tuple[str, int, int]]:
    """(rule, first line, last line) of an example, lines from 1."""
    out = []
    for x in found.split():
        rule, _, lines = x.partition("@")
        first, _, last = (lines or f"1-{code.count(chr(10)) + 1}").partition("-")
        out.append((rule, int(first), int(last or first)))
    return out


def source(language: str, code: str) -> str:
    """An example as a file."""
    return f"{HEADS[language]}\n{code}\n" if HEADS[language] else f"{code}\n"


def tests(rule: str, language: str) -> list[tuple[str, bool]]:
    """Code of a rule's language, and whether it is found."""
    out = []
    for code, found, near in EXAMPLES[language]:
        if rule in near.split():
            out.append((source(language, code), False))
        elif any(rule == r for r, _, _ in hits(code, found)):
            out.append((source(language, code), True))
    return out
